"""Durable records next to the data: datasets, runs, reports and the budget ledger, as append-only tables."""

from __future__ import annotations

import os
import secrets
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions.masking import table_fingerprint
from facsimile.operators.accounting import MAX_EPSILON, admit_stated, budget_state
from facsimile.operators.facts import collect_facts
from facsimile.operators.roles import coarse_type
from facsimile.session import local_rows
from facsimile.sources.tables import read_table

SCHEMAS = {
    "datasets": "id string, filename string, path string, source string, num_rows long, num_cols int,"
                " columns array<string>, column_types map<string,string>, fingerprint string, created_at timestamp",
    "runs": "run_id string, dataset_id string, status string, output string, source string, created_at timestamp",
    "reports": "report_id string, type string, dataset_id string, pillar string, metric string, value string,"
               " created_at timestamp",
    "ledger": "dataset_id string, seq long, epsilon double, delta double, operation string, accepted boolean, max_epsilon double",
}
COMPLETED = "completed"


def latest_outputs(runs: DataFrame) -> DataFrame:
    """``(dataset_id, output)``: the newest completed output per dataset."""
    return runs.where(F.col("status") == COMPLETED).groupBy("dataset_id").agg(
        F.max_by("output", "created_at").alias("output")
    )


class Registry:
    """Tables under one folder that every executor can reach.

    The ledger is a log of requests, one file each, named by its number.  A number is claimed by a step that the file
    system makes atomic (a hard link, or a rename that never replaces), so requests of any number of processes have
    one order, and whoever reads the log comes to the same verdicts by ``accounting``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self._ledger() if name == "ledger" else self._read(name)

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            # only a table that was never written is empty; anything else must not read as a fresh budget
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: list[tuple]) -> None:
        local_rows(self.spark, rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def register_dataset(self, path: str, filename: str, source: str = "parquet", order_by=None) -> str:
        """Record a table: sizes, coarse column types and an order-independent fingerprint of its rows."""
        df = read_table(self.spark, path, source)
        types = {f.column: coarse_type(f) for f in collect_facts(df, order_by)}
        print_row = table_fingerprint(df).first()
        dataset_id = f"ds_{secrets.token_hex(8)}"
        self._append("datasets", [(
            dataset_id, filename, path, source, print_row["num_rows"], len(df.columns), df.columns, types,
            print_row["fingerprint"], datetime.now(timezone.utc),
        )])
        return dataset_id

    def datasets(self) -> DataFrame:
        return self.table("datasets").orderBy("created_at")

    def dataset(self, dataset_id: str):
        """The record of one dataset, or None."""
        return self.table("datasets").where(F.col("id") == dataset_id).first()

    def load_dataset(self, dataset_id: str) -> DataFrame | None:
        record = self.dataset(dataset_id)
        return read_table(self.spark, record["path"], record["source"]) if record else None

    def record_run(self, dataset_id: str, output: str | None, status: str = COMPLETED, source: str = "parquet") -> str:
        run_id = f"run_{secrets.token_hex(8)}"
        self._append("runs", [(run_id, dataset_id, status, output, source, datetime.now(timezone.utc))])
        return run_id

    def load_output(self, dataset_id: str | None = None, run_id: str | None = None, path: str | None = None) -> DataFrame | None:
        """A synthetic table: by run, else by path, else the newest completed one of the dataset."""
        runs = self.table("runs")
        if run_id:
            record = runs.where(F.col("run_id") == run_id).first()
        elif path:
            record = runs.where(F.col("output") == path).first()
        else:
            newest = latest_outputs(runs.where(F.col("dataset_id") == dataset_id)).select("output")
            record = runs.join(F.broadcast(newest), "output", "left_semi").first()
        return read_table(self.spark, record["output"], record["source"]) if record and record["output"] else None

    def save_report(self, kind: str, dataset_id: str, metrics: DataFrame) -> str:
        """Append ``(pillar, metric, value)`` rows as one report."""
        report_id = f"rep_{secrets.token_hex(8)}"
        metrics.select(
            F.lit(report_id).alias("report_id"), F.lit(kind).alias("type"), F.lit(dataset_id).alias("dataset_id"),
            "pillar", "metric", F.col("value").cast("string").alias("value"),
            F.lit(datetime.now(timezone.utc)).alias("created_at"),
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/reports")
        return report_id

    def report(self, report_id: str) -> DataFrame:
        return self.table("reports").where(F.col("report_id") == report_id)

    def reports(self) -> DataFrame:
        return self.table("reports").groupBy("report_id", "type", "dataset_id").agg(F.min("created_at").alias("created_at"))

    def _requests(self) -> DataFrame:
        """The log in the order of its numbers; a file without one is of a ledger that still held its verdicts."""
        number = F.try_to_number(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d{19})\.parquet$", 1), F.lit("9999999999999999999")).cast("long")
        try:
            log = self._read("ledger").select("*", number.alias("number"))
        except AnalysisException:  # an empty table has no files to name
            log = self._read("ledger").withColumn("number", F.lit(None).cast("long"))
        settled = F.col("number").isNull()
        # verdicts of the old form stand: before all numbers, and within any budget
        kept = log.where(~settled | F.col("accepted"))
        return kept.select(
            "dataset_id", F.when(settled, F.col("seq") - F.lit(1 << 62)).otherwise(F.col("number")).alias("seq"), "epsilon", "delta", "operation",
            F.when(settled, F.lit(1e12)).otherwise(F.col("max_epsilon")).alias("max_epsilon"))

    def _ledger(self, dataset_id: str | None = None, upto: int | None = None) -> DataFrame:
        log = self._requests()
        if dataset_id is not None:
            log = log.where(F.col("dataset_id") == dataset_id)
        if upto is not None:
            log = log.where(F.col("seq") <= upto)
        return admit_stated(log, "max_epsilon")

    def _claim(self, source: str, target: str) -> bool:
        """Give a written file its number, unless another process was first."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        if new.getFileSystem(conf).getScheme() == "file":
            try:
                os.link(old.toUri().getPath(), new.toUri().getPath())
            except FileExistsError:
                return False
            return True
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(old, new, options)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _log(self, row: tuple) -> int:
        """Append one request to the log; returns its number."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        pending = path(".pending", secrets.token_hex(16))
        local_rows(self.spark, [row], SCHEMAS["ledger"]).coalesce(1).write.parquet(pending.toString())
        fs = pending.getFileSystem(conf)
        fs.mkdirs(path("ledger"))
        written = next(f.getPath().toString() for f in fs.listStatus(pending) if f.getPath().getName().startswith("part-"))
        names = [f.getPath().getName() for f in fs.listStatus(path("ledger"))]
        number = 1 + max((int(n[5:24]) for n in names if len(n) == 32 and n[5:24].isdigit()), default=0)
        # every smaller number is taken, so nothing can come before this request once it has its own
        while not self._claim(written, path("ledger", f"part-{number:019d}.parquet").toString()):
            number += 1
        fs.delete(pending, True)
        return number

    def spend(self, dataset_id: str, epsilon: float, delta: float, operation: str, max_epsilon: float = MAX_EPSILON) -> bool:
        """Charge the budget if the request still fits.  The request is logged first, and the log decides."""
        number = self._log((dataset_id, None, float(epsilon), float(delta), operation, None, float(max_epsilon)))
        return self._ledger(dataset_id, number).where(F.col("seq") == number).first()["accepted"]

    def budget(self, dataset_id: str, max_epsilon: float = MAX_EPSILON):
        """The budget row of one dataset; a fresh one when nothing was spent."""
        known = local_rows(self.spark, [(dataset_id,)], "dataset_id string")
        return budget_state(self._ledger(dataset_id), max_epsilon, known).first()

    def budgets(self, max_epsilon: float = MAX_EPSILON) -> DataFrame:
        known = self.table("datasets").select(F.col("id").alias("dataset_id"))
        return budget_state(self.table("ledger"), max_epsilon, known)
