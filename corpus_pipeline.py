"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one with its sampling plan, which the reader of the result carries out:
toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark
item go, personal data is replaced by its kind, and every document gets the copies its source is due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import decontam, jaccard, mixing, pii, toxicity
from facsimile.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that reach the threshold of their language go; null and empty texts are judged like any other."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more.

    Texts without words and rows with a null id stay; of rows that repeat an id one stays; an empty table stays empty.
    """
    return jaccard.keep_one(docs, jaccard.Settings(width=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go; null and empty texts and items match nothing, repeated rows share their fate."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampling plan: every row stays, with its copies; texts without words cost nothing, a null source is a source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and components are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None
