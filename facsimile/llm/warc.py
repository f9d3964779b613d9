"""WARC files: written by the text sink, read back in byte ranges, records found by boundary chains.

Writing: one record a page, equal payloads of at least ``LEAST_REPEATED`` bytes once as a response, else as
revisits of it.  The sink ends each row with the blank line that ends a record, so its files are plain WARC.

Reading: files are split wherever Spark likes.  Every task cuts its range at the version line and emits, for
each piece that begins with a readable header, a candidate: its offset and that of its successor (header
and Content-Length say where the next record must begin).  The version line may also stand inside a
payload; such a candidate may look perfect.  Only what can be reached from offset 0 of the file is a record.
Tasks contract their own chains (where does a chain that enters here leave the range?), pointer jumping
over those exits finds in log2(ranges of a file) rounds where the chain from 0 enters each range, and the
ranges are then walked from there.  Payloads that hold a version line are put together from their pieces.

A task holds the offsets of one range and one payload at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import small_batches, stored
from facsimile.session import checkpoint_dir

VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
LEAST_REPEATED = 100
DATE = "2024-01-01T00:00:00Z"
_MARK, _GAP = len(VERSION), len(BLANK)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends inside the value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, identity: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REPEATED, date: str = DATE) -> DataFrame:
    """``value``: the bytes of one record for each page, without the blank line at its end.

    Of equal payloads of at least ``least`` bytes the smallest id is the response (all rows of that id),
    the others revisit it.  A null id is larger than every other; where all ids are null, all are responses.
    A null payload is empty.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    told = pages.select(F.col(identity).alias("_id"), F.col(url).alias("_url"), body.alias("_body")).withColumns(
        {"_size": F.octet_length("_body"), "_digest": F.sha2("_body", 256)})
    repeated = (
        told.where(F.col("_size") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_digest", "_first")
    )
    joined = told.join(stored(repeated, "repeated"), "_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("_size") >= least) & F.coalesce(F.col("_id") > F.col("_first"), F.lit(True))
    header = F.concat(
        F.lit(VERSION), F.when(again, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("_url")), _line("Page-Id", F.col("_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                               _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
                               F.lit("Content-Length: 0\r\n\r\n")))
        .otherwise(F.concat(F.lit("Content-Type: text/html\r\n"), _line("Content-Length", F.col("_size")), F.lit("\r\n"))),
    )
    return joined.select(F.concat(header.cast("binary"), F.when(again, F.lit(b"")).otherwise(F.col("_body"))).cast("string").alias("value"))


def write(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write the records of ``pages`` as WARC files in a folder (by default a new one in the shared folder) and return it."""
    target = path or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    records(pages, **options).write.option("lineSep", BLANK).text(target)
    return target


def _header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """(length of the header with its blank line, fields) if ``piece`` begins with one that has a Content-Length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (end + 4, fields) if fields.get("content-length", "").isdigit() else None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between version lines, in file order within each range: file, range (its first byte), size (of the file), piece."""
    read = spark.read.option("lineSep", VERSION).option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    return read.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("range"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("piece"))


_CANDIDATE = (
    "file string, range bigint, size bigint, kind int, at bigint, succ bigint, leaves bigint, body bigint, length bigint, whole boolean, "
    "type string, page string, refers string, uri string, told string, digest string, payload binary"
)
_NAMES = [part.split()[0] for part in _CANDIDATE.split(", ")]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in _CANDIDATE.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)


def _candidates(keep_payload: bool):
    """Offsets are counted from the first piece of the range: kind 0 is the range's own row (``at``: its bytes), 1 a candidate, 2 another piece."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, passed = None, [], 0

        def finished() -> pa.RecordBatch:
            file, start, size = place
            exits: dict[int, int | None] = {}
            done = []
            for at, succ, *rest in reversed(rows):
                leaves = None
                if succ is not None:
                    leaves = succ if succ >= passed - _MARK else exits.get(succ)
                    exits[at] = leaves
                done.append((file, start, size, 2 if succ is None else 1, at, succ, leaves, *rest))
            return _arrow([(file, start, size, 0, passed, *[None] * 12), *done])

        for batch in batches:
            files, ranges, sizes, pieces = batch.columns
            for k in range(batch.num_rows):
                here = (files[k].as_py(), ranges[k].as_py(), sizes[k].as_py())
                if here != place:
                    if place is not None:
                        yield finished()
                    place, rows, passed = here, [], 0
                piece = pieces[k].as_py()
                at = passed - _MARK
                passed += len(piece) + _MARK
                found = None if here[1] == 0 and at == -_MARK else _header(piece)  # what stands before the first version line is no record
                if found is None:
                    rows.append((at, None, None, None, None, None, None, None, None, None, None, None))
                    continue
                head, fields = found
                length = int(fields["content-length"])
                if length > here[2]:
                    rows.append((at, None, None, None, None, None, None, None, None, None, None, None))
                    continue
                whole = len(piece) >= head + length
                body = piece[head : head + length] if whole else None
                rows.append((
                    at, at + _MARK + head + length + _GAP, at + _MARK + head, length, whole, fields.get("warc-type"), fields.get("page-id"),
                    fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
                    hashlib.sha256(body).hexdigest() if whole else None, body if keep_payload else None))
        if place is not None:
            yield finished()

    return scan


def _entries(steps: DataFrame) -> DataFrame:
    """(file, at): where the chain from offset 0 enters each range, by pointer jumping over ``steps`` (file, at, leaves)."""
    reached = steps.where("at = 0").select("file", "at")
    targets = steps.where("leaves IS NOT NULL").select("file", F.col("leaves").alias("at")).distinct()
    jumps = stored(steps.where("leaves IS NOT NULL").join(targets.unionByName(reached).distinct(), ["file", "at"], "left_semi").select("file", "at", "leaves"), "jumps")
    reached = stored(reached, "reached")
    known = reached.count()
    while True:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = stored(reached.unionByName(onward).distinct(), "reached")
        count = reached.count()
        if count == known:
            return reached
        known = count
        far = jumps.select("file", F.col("at").alias("_from"), F.col("leaves").alias("at")).join(jumps, ["file", "at"])
        jumps = stored(far.select("file", F.col("_from").alias("at"), "leaves"), "jumps")


def _walked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one range on the chain from its entry."""
    steps = dict(zip(rows["at"], rows["succ"]))
    at, found = rows["entry"].iloc[0], []
    while at in steps:
        found.append(at)
        at = steps[at]
    return pd.DataFrame({"file": key[0], "at": pd.Series(found, dtype="int64")})


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the WARC files under ``path``: file, at, type, page, uri, refers, told (the header's digest), length, digest[, payload].

    ``length`` and ``digest`` (hex SHA-256) are of the bytes in the file.  A file that does not begin with a
    record, and whatever follows a record that is cut short, gives nothing.
    """
    small_batches(spark)
    scanned = stored(_pieces(spark, path).mapInArrow(_candidates(payload), _CANDIDATE), "candidates")
    base = F.sum("at").over(W.partitionBy("file").orderBy("range")) - F.col("at")
    bases = stored(scanned.where("kind = 0").select("file", "range", base.alias("base")), "ranges")
    moved = scanned.where("kind > 0").join(bases, ["file", "range"]).withColumns(
        {c: F.col(c) + F.col("base") for c in ("at", "succ", "leaves", "body")}).drop("base")
    steps = moved.where((F.col("kind") == 1) & (F.col("body") + F.col("length") <= F.col("size")))
    slim = stored(steps.select("file", "range", "at", "succ", "leaves"), "steps")
    entry = slim.join(_entries(slim.select("file", "at", "leaves")), ["file", "at"]).select("file", "range", F.col("at").alias("entry"))
    chained = stored(
        slim.join(entry, ["file", "range"]).groupBy("file", "range").applyInPandas(_walked, "file string, at bigint"), "chain")
    names = ["file", "at", "type", "page", "uri", "refers", "told", "length", "digest", *(["payload"] if payload else [])]
    kept = steps.join(chained, ["file", "at"])
    broken = stored(kept.where("NOT whole").drop("digest", "payload", "whole", "kind", "range", "leaves"), "broken")
    if not broken.take(1):
        return kept.select(*names)
    # a version line inside the payload: every piece up to the next record belongs to the last one begun
    owner = F.last(F.when(F.col("own"), F.col("at")), ignorenulls=True).over(W.partitionBy("file").orderBy("at"))
    some = broken.select("file").distinct()
    marked = (
        moved.join(some, "file", "left_semi").select("file", "range", "at").join(chained.withColumn("own", F.lit(True)), ["file", "at"], "left")
        .withColumn("owner", owner).join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
        .join(bases, ["file", "range"]).select("file", "range", (F.col("at") - F.col("base")).alias("local"), "at", "owner")
    )
    joined = _pieces(spark, path).mapInArrow(_located, "file string, range bigint, local bigint, piece binary").join(marked, ["file", "range", "local"])
    parts = joined.join(broken.select("file", F.col("at").alias("owner"), "body", "length"), ["file", "owner"])
    whole = parts.groupBy("file", "owner").applyInPandas(_assembled, "file string, at bigint, digest string, payload binary")
    mended = broken.join(whole, ["file", "at"]).select(*names)
    return kept.where("whole").select(*names).unionByName(mended)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each range with their offsets counted from its first piece."""
    place, passed = None, 0
    for batch in batches:
        files, ranges, _, pieces = batch.columns
        local = []
        for k in range(batch.num_rows):
            here = (files[k].as_py(), ranges[k].as_py())
            if here != place:
                place, passed = here, 0
            local.append(passed - _MARK)
            passed += len(pieces[k].as_buffer()) + _MARK
        yield pa.RecordBatch.from_arrays([files, ranges, pa.array(local, pa.int64()), pieces], ["file", "range", "local", "piece"])


def _assembled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One payload from its pieces."""
    rows = rows.sort_values("at")
    first = rows.iloc[0]
    text = VERSION.encode().join(bytes(p) for p in rows["piece"])
    skip = int(first["body"] - first["at"] - _MARK)
    body = text[skip : skip + int(first["length"])]
    return pd.DataFrame({"file": [key[0]], "at": [key[1]], "digest": [hashlib.sha256(body).hexdigest()], "payload": [body]})


def summary(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the size of the response it stands for."""
    page, refers = F.col("page").cast("long"), F.regexp_extract("refers", "<urn:page:(-?[0-9]+)>", 1)
    answered = found.where("type = 'response'").groupBy("digest").agg(F.max("length").alias("_bytes"))
    told = found.select(
        page.alias("page_id"), "length", "type", F.when(F.col("type") == "revisit", F.regexp_replace("told", "^sha256:", "")).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("type") == "revisit", refers.cast("long")).alias("refers_to"))
    again = told.where("type = 'revisit'").join(answered, "digest", "left").withColumn("length", F.col("_bytes")).drop("_bytes").select(*told.columns)
    return told.where("type = 'response'").unionByName(again).select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
