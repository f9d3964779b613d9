"""Session helpers: settings the operators rely on and reliable lineage cuts."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CHECKPOINT_SETTING = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where the cluster names none."""
    folder = spark.conf.get(_CHECKPOINT_SETTING, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(_CHECKPOINT_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="facsimile-checkpoint-")
        spark.conf.set(_CHECKPOINT_SETTING, folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that a lost executor replays files, not the plan.

    What was shuffled for it is not needed again and leaves the disks.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` returned and nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession, ceiling: int = 1024) -> int:
    """How many ranges an ordered pass is cut into: the session's shuffle width, bounded."""
    return max(2, min(ceiling, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-side table of per-column results; its exact size is known to the optimizer."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    arrow = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(arrow, schema=struct)
