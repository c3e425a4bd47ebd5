"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last keep the columns of documents:

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of texts linked by SimHash and a 5-word shingle similarity of 0.8 one stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. personal_data: selected spans are replaced by their kind in angle brackets; every document stays.
5. packing: documents become pieces in sequences of at most 2048 ids.

Null and empty texts: they are scored like any empty text, share one near-duplicate group, hold no passage and no
personal data, and pack as one id.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontamination, near_copies, packing, pii, quality, simhash
from tidebook.llm.common import fresh, shared_checkpoint, shared_folder, table

#: Words whose ids a worker remembers: all stages' workers live on side by side, so fewer than where packing is alone.
CACHE_WORDS = 250_000

#: SQL can express neither the classifiers nor the tokeniser; the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, fitted on the labels that are not held out, scores at its threshold or above."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = fresh(docs.columns, "quality_score")
    scored = quality.annotate(docs, model, out=out)
    return scored.where(F.col(f"{out}.score") >= quality.THRESHOLD).drop(out)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, texts with a shingle similarity of 0.8 or more, keep the smallest id."""
    return simhash.keep_one(docs, grouped=near_copies.similar(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark window."""
    out = fresh(docs.columns, "contamination")
    found = decontamination.annotate(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(F.col(f"{out}.n_hit") == 0).drop(out)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in all documents."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return packing.pack(shared_checkpoint(packing.pieces_of(docs, cache_words=CACHE_WORDS)))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
