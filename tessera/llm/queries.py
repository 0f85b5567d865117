"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .decontam import op10_decontamination
from .hilbert import op9_shard
from .imi import op6_neighbours
from .langid import op7_language
from .mix import OP1_SQL, op1_mix
from .neardup import op3_near_dup
from .tokenbin import op2_token_files
from .tokencount import op8_token_counts
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_mix": op1_mix,
    "op2_token_files": op2_token_files,
    "op3_near_dup": op3_near_dup,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_neighbours": op6_neighbours,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_shard": op9_shard,
    "op10_decontamination": op10_decontamination,
}

ORACLE = {"op1_mix": OP1_SQL, "op4_chat": OP4_SQL, "op5_warc": OP5_SQL}
