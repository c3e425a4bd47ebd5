"""Quality classifier: an additive model with pairwise interactions over features of whole texts.

Labels are learned from at most ``train_rows`` labelled documents (those of smallest id hash), never from held-out
ones; every document is scored.  Features come from the bytes of the text alone.

Defined cases: a null text counts as empty; an empty text has all features zero and gets that row's score; rows
with a null label are not learned from; a document with several labels has their rounded mean; repeated documents
are scored one by one; without labels every score is 0.5; a null id is never held out; other columns are carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.additive_model import AdditiveModel, fit
from tidebook.llm.common import map_text, table

#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 10_000
THRESHOLD = 0.7

FEATURES = (
    "log_bytes",
    "upper",
    "digit",
    "punctuation",
    "symbol",
    "pipe",
    "exclamation",
    "non_ascii",
    "space",
    "newline",
    "mean_word",
    "unique_words",
    "unique_lines",
    "mean_line",
    "longest_word",
    "symbol_words",
)

_CLASS = np.zeros((8, 256))
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?()-", b"#$%&*@^~<>{}[]\\/=+_`", b"|", b"!")):
    _CLASS[_row, list(_chars)] = 1
_CLASS[6, 0x80:] = 1
_CLASS[7, [0x20, 9, 10, 11, 12, 13]] = 1

_SCORE = T.StructType([T.StructField("score", T.DoubleType())])
_FEATURES = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])


def features(raw: bytes | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, digit, punctuation, symbol, pipe, exclamation, foreign, space = (_CLASS @ counts).tolist()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    many = max(1, len(words))
    ends = sum(1 for w in words if w[-1] in b"#$%&*!|")
    return [
        float(np.log1p(n)),
        upper / n,
        digit / n,
        punctuation / n,
        symbol / n,
        pipe / many,
        exclamation / many,
        foreign / n,
        space / n,
        float(counts[10]) / n,
        (n - space) / many,
        len(set(words)) / many,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log1p(max(map(len, words), default=0))),
        ends / many,
    ]


def remainder(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(modulus))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> AdditiveModel:
    """Fit on a bounded sample of labelled documents that are not held out."""
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
        .where(F.col("y").isNotNull() & F.col("id").isNotNull())
        .where(remainder("id", 4) != 2)
        .groupBy("id")
        .agg(F.round(F.avg("y")).alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)  # at most train_rows ids: safe to broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id")

    rows = (
        map_text(sample, "text", lambda: lambda batch: [{"x": features(t)} for t in batch], _FEATURES, "f", ["id", "y"], True)
        .groupBy("id", "y")
        .agg(F.max("f.x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float))


def annotate(
    docs: DataFrame,
    model: AdditiveModel,
    text_col: str = "text",
    out: str = "quality_score",
    carry: list[str] | None = None,
) -> DataFrame:
    """Documents with a struct column holding the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: [{"score": s} for s in own.score(np.array([features(t) for t in texts])).tolist()] if texts else []

    return map_text(docs, text_col, make, _SCORE, out, carry, binary=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score.score")
    return annotate(docs, model, carry=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )
