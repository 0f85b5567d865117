"""A corpus from raw documents: language, near-duplicates, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mix, neardup, tokenbin
from tessera.llm.shared import materialize


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbers for column names, so that none can clash with an operator's own; and the names."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text or no letter); the rest stay with the language found."""
    model = langid.fit(docs.filter(~langid.held_out()))
    own, name = numbered(docs)
    found = langid.predict(own, model, name["text"]).filter("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in name.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id."""
    return neardup.dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document that is taken twice is there twice."""
    own, name = numbered(docs)
    taken = mix.repeat(mix.mix(own, name["doc_id"], name["text"], name["source"]))
    return taken.select(*[F.col(n).alias(c) for c, n in name.items()])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and what they hold of each document."""
    return tokenbin.read_tokens(tokenbin.write_tokens(docs, tokenbin.default_tokenizer()))


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("token_files", write_token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
