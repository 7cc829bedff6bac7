"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``LEAST_SCORE`` or more.

    A null text is scored as an empty one; without labels of both kinds every score is
    0.5 and all stay; repeated rows are kept or go together; an empty table stays empty.
    """
    from rillflow.llm import queries, quality
    from rillflow.llm.common import fresh

    score = fresh("score")
    scored = quality.score(docs, queries.quality_model(docs, spark, sf_dir), score)
    return scored.where(F.col(score) >= queries.LEAST_SCORE).select(docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document whose whole text stands in earlier ones goes with them.

    One that came null, empty or blank stays, as does one with a null id; rows repeated
    whole are one document and are treated alike; an empty table stays empty.
    """
    from rillflow.llm.common import fresh
    from rillflow.llm.line_dedup import line_dedup

    removed = fresh("removed")
    done = line_dedup(docs, removed_col=removed)
    emptied = (F.col(removed) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x20]")
    return done.where(~emptied).select(docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the least id.

    Null, empty and blank texts and null ids are in no group and stay; rows that share
    the id that stays all stay; an empty table stays empty.
    """
    from rillflow.llm.near_dedup import near_dedup

    return near_dedup(docs, width=5, percent=80).select(docs.columns)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts and null ids stay, an empty table stays empty."""
    from rillflow.llm.decontamination import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end token, repeated rows are packed each, no rows give none."""
    from rillflow.llm import queries
    from rillflow.llm.packing import pack

    return pack(docs, queries.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _quality),
    ("line_dedup", _lines),
    ("near_dedup", _near),
    ("decontamination", _benchmark),
    ("packing", _packing),
]

#: A learned classifier and a byte-level tokenizer are beyond SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again for the next, then removed."""
    from rillflow.llm.common import release, shared_folder

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            release(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
