"""What several of these operators share: shared-folder tables, word patterns and row orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.session import checkpoint_dir

#: Rows of keys that may be broadcast; a longer table of keys is joined by shuffle.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: its lineage ends there and its size is known.

    Unlike a checkpoint the planner sees the size in bytes, so that a join broadcasts it only below
    the session's ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended what no column of ``df`` is called, in whatever case: for helper columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_but(names: list[str], made: tuple[str, ...]) -> list[str]:
    """``names`` without those that an operator makes itself, in whatever case."""
    return [c for c in names if c.lower() not in made]


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table written by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/llm-" in f}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def counted(keys: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast when it is counted at ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to ``rows`` rows: a batch of whole texts is held several times over, by
    the JVM and by Python.  A smaller setting stays as it is; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A column named by ``withColumn`` may be substituted wherever it is used, inside a lambda once for
    every element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
