"""Language identification in two levels: family first, then one-against-one linear SVMs inside it.

Features are hashed runs of one to three letters, as square roots of their shares of the whole text.  A
linear SVM per family (one against the rest) chooses the family; within it each pair of languages has a
linear SVM, and the language with most votes (then margin) wins.  All are trained here, by averaged
subgradient steps on a bounded sample of labelled documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worker import tool

DIM_BITS = 12
SAMPLE = 2400  # labelled documents that are fitted on, in all (two of each language if those are more)
AT_ONCE = 256  # families fitted in one product
PREDICTED = "lang_pred string, score double"

# Families of languages by their usual codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn ur mr pa gu ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


class Features:
    """Sparse vector of a text: (indexes, values) of unit length; None without a letter."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.letter = np.zeros(0x110000, dtype=bool)
        self.letter[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True

    def __call__(self, text: str | None):
        np = self.np
        if not text:
            return None
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = self.letter[code]
        if not letter.any():
            return None
        code = np.where(letter, code, 32)
        code = np.concatenate([[32], code, [32]]).astype(np.uint32)
        space = code == 32
        code = code[~(space & np.concatenate([[False], space[:-1]]))]  # one space between words
        with np.errstate(over="ignore"):
            one = code * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ (code[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
            three = (two[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        h = np.concatenate([one[code != 32], two, three]) >> np.uint32(32 - DIM_BITS)
        counts = np.bincount(h, minlength=1 << DIM_BITS)
        at = np.flatnonzero(counts)
        v = np.sqrt(counts[at])
        return at.astype(np.uint16), (v / np.sqrt((v * v).sum())).astype(np.float32)


def _features() -> Features:
    return tool("features", Features)


def fit_svm(x, y, rounds: int = 200, penalty: float = 1e-4):
    """(w, b) of a linear SVM: hinge loss, class-balanced, averaged subgradient steps; of one a column if y has columns."""
    import numpy as np

    y = y.astype(np.float32)  # all in single precision, else each product converts the whole matrix
    share = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(0)), 0.5 / np.maximum(1, (y < 0).sum(0))).astype(np.float32)
    w, b = np.zeros((x.shape[1], *y.shape[1:]), dtype=np.float32), np.zeros(y.shape[1:])
    sw, sb = w.copy(), 0.0
    for t in range(1, rounds + 1):
        g = share * y * (y * (x @ w + b.astype(np.float32)) < 1)
        step = np.float32(8.0 / t**0.5)
        w = w * (1 - step * np.float32(penalty)) + step * (x.T @ g)
        b = b + (step * g.sum(0)).astype(np.float64) * 0.1
        if t > rounds // 2:
            sw, sb = sw + w, sb + b
    half = rounds - rounds // 2
    return sw / np.float32(half), sb / half


class Model:
    """A family level and pairs of languages."""

    def __init__(self, x, langs: list[str]):
        import numpy as np

        self.langs = sorted(set(langs))
        y = np.array(langs)
        home = {v: family(v) for v in self.langs}
        of = np.array([home[v] for v in langs])
        self.families = sorted(set(home.values()))
        self.members = {f: [] for f in self.families}
        for v in self.langs:
            self.members[home[v]].append(v)
        parts = []
        if len(self.families) > 1:
            for k in range(0, len(self.families), AT_ONCE):
                some = self.families[k : k + AT_ONCE]
                w, b = fit_svm(x, np.where(of[:, None] == np.array(some), 1.0, -1.0))
                parts += [(("family", f, ""), (w[:, j], b[j])) for j, f in enumerate(some)]
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                on = (y == a) | (y == b)
                parts.append((("pair", a, b), fit_svm(x[on], np.where(y[on] == a, 1.0, -1.0))))
        self.keys = [k for k, _ in parts]
        self.w = np.array([w for _, (w, _) in parts], dtype=np.float32).T.copy() if parts else np.zeros((x.shape[1], 0), dtype=np.float32)
        self.b = np.array([b for _, (_, b) in parts])

    def __call__(self, features) -> tuple[str, float]:
        import numpy as np

        at, v = features
        m = dict(zip(self.keys, (v @ self.w[at] + self.b).tolist(), strict=True))
        sure = 1.0
        best = self.families[0]
        if len(self.families) > 1:
            best = max(self.families, key=lambda f: m["family", f, ""])
            sure = 1 / (1 + np.exp(-2 * m["family", best, ""]))
        own = self.members[best]
        votes = {a: [0, 0.0] for a in own}
        for a, b in combinations(own, 2):
            margin = m["pair", a, b]
            votes[a if margin >= 0 else b][0] += 1
            votes[a][1] += margin
            votes[b][1] -= margin
        lang = max(own, key=lambda a: votes[a])
        if len(own) > 1:
            sure *= 1 / (1 + np.exp(-2 * votes[lang][1] / (len(own) - 1)))
        return lang, float(sure)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` rows with a language and a text, as many of each language.

    Every language that occurs is fitted: with more than ``sample`` / 2 of them the sample is two rows of each,
    16 KB a row on the driver.  The sample is the rows whose hash lies below a threshold, which follows from the languages' counts over
    all rows; no sort, and the same rows at each run.  None if there is no such row.
    """
    import numpy as np

    i, text, lang = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    rows = df.filter(lang.isNotNull()).select(i.alias("i"), text.alias("text"), lang.alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(2, sample // len(counts))
    # a join, not a map literal, which would be searched from its start at each row; it is on the driver already
    shares = df.sparkSession.createDataFrame([(v, min(1.0, 1.2 * (each + 10) / n)) for v, n in counts.items()], "lang string, share double")
    # the hash of the text is in it so that one id on many rows does not decide for all of them
    h = F.pmod(F.xxhash64("i", "text"), F.lit(1 << 30))
    known = rows.filter(F.col("text").isNotNull()).withColumn("h", h).join(F.broadcast(shares), "lang")
    taken = known.filter(F.col("h") < F.col("share") * float(1 << 30)).drop("share")

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = _features()
        for batch in batches:
            for t, lang, h in zip(*(batch.column(k) for k in ("text", "lang", "h")), strict=True):
                if (f := make(t.as_py())) is not None:
                    yield pa.RecordBatch.from_pydict({"lang": [lang.as_py()], "h": [h.as_py()], "at": [f[0].tobytes()], "v": [f[1].tobytes()]})

    got = sorted(taken.mapInArrow(features, "lang string, h long, at binary, v binary").collect(), key=lambda r: (r["lang"], r["h"], bytes(r["at"])))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in got:
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= each:
            kept.append(r)
    if not kept:
        return None
    x = np.zeros((len(kept), 1 << DIM_BITS), dtype=np.float32)
    for row, r in zip(x, kept, strict=True):
        row[np.frombuffer(r["at"], dtype=np.uint16)] = np.frombuffer(r["v"], dtype=np.float32)
    return Model(x, [r["lang"] for r in kept])


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score.

    Defined cases: a null text, one without a letter, or no model give ``und`` with score 0; columns named
    like the outputs are replaced; rows stay as they are otherwise, repeated ones too.
    """
    rows = df.drop("lang_pred", "score")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = _features()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = []
            for t in texts:
                f = make(t.as_py()) if model is not None else None
                found.append(("und", 0.0) if f is None else model(f))
            columns = [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 1 when divided by 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
