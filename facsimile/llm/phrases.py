"""Phrase collocations by dynamic itemset counting over word sequences.

The corpus is dealt to shards that are scanned in a cycle.  Words are counted from the first scan on; a longer
phrase is counted as soon as both phrases that it is made of (without its last and without its first word)
have reached the threshold, from the next shard until it has met every shard once.  So lengths interleave:
while the last words are still counted, phrases of frequent words are counted already, and the scans
end when no phrase is left inside its cycle.

A scan knows which phrases have reached the threshold, and in which scan, from tables of one byte for each of
``slots`` hash values a length.  A slot keeps the first scan in which any of its phrases reached the threshold, so a
phrase's cycle is fixed by its slots and the same in every task: it is counted in every shard exactly once.
A slot shared by two phrases only lets a phrase be counted that need not be.  Pairs of words have
one table more, of summed occurrences by slot: a pair is counted one by one from the scan after its slot has
the threshold.  These tables have a fixed size; on a corpus that fills them more phrases are counted than
need be, and the result is the same.

Counts are exact: a phrase is keyed by the 64-bit hashes of its words, and every phrase that occurs
``least`` times has only parts that do.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import drop_stored, stored
from facsimile.llm.tokens import byte_table, hash_words, mixed, portions, word_bounds
from facsimile.session import checkpoint_dir

#: What ends a piece, and what else ends a word.
ENDS = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
WITHIN = np.array([not (ENDS[b] or b in (32, 9)) for b in range(256)])

_RANGE = 1 << 15  # slots in a row of a bitmap or of sums
NEVER = 255  # the slot's phrases have not reached the threshold
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_SEED, _LANG_SEED, _RUN_SEED = 17, 18, 29  # words and languages apart, or a word that is its language's name has no hash of its own


@dataclass(frozen=True)
class Settings:
    """``held``: entries that a task keeps before it passes its counts on."""

    least: int = 100
    longest: int = 5
    shards: int = 3
    slots: int = 1 << 22
    held: int = 1 << 20
    top: int = 2000
    contained: int = 100  # percent

    def __post_init__(self):
        if self.longest < 2 or self.slots & (self.slots - 1) or (self.longest + 1) * self.shards >= NEVER:
            raise ValueError("two words at least, a power of two slots, and fewer than 255 scans")


class _Tally:
    """Counts of phrases of one length by hash, with the word hashes of each; passed on when they are many."""

    def __init__(self, length: int, held: int):
        self.length, self.held, self.size = length, held, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, run: np.ndarray, words: np.ndarray) -> None:
        keys, first, n = np.unique(run, return_index=True, return_counts=True)
        self.put(keys, words[first], n)

    def put(self, keys: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, words, n))
        self.size += len(keys)
        if self.size > self.held and len(self.parts) > 1:
            self._merge()

    def _merge(self) -> None:
        keys, first, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        words = np.concatenate([p[1] for p in self.parts])[first]
        n = np.bincount(inverse, weights=np.concatenate([p[2] for p in self.parts]), minlength=len(keys)).astype(np.int64)
        self.parts, self.size = [(keys, words, n)], len(keys)

    def taken(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """What is to be passed on: all at the end, or when merging no longer makes it small."""
        if not self.parts or not last and self.size <= self.held // 2:
            return None
        self._merge()
        if not last and self.size <= self.held // 2:
            return None
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def _lang_hash(langs: pa.Array, table: np.ndarray) -> np.ndarray:
    raw = [x.encode() for x in langs.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return hash_words(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:], table)[0]


def _scan(step: int, told: list[bytes], lengths: list[int], sums: bool, settings: Settings):
    """The scan of one shard.  ``told``: packed tables, first those of ``reached`` by length (first scan by slot in which a phrase of
    k + 1 words had the threshold), last that of the sums of pairs.  Emits (key, lang, word, n), and (slot range, sums) of pairs under ``key`` null."""
    mask, cycle = np.uint64(settings.slots - 1), settings.shards
    table, tongues = byte_table(_TABLE_SEED, lower=True), byte_table(_LANG_SEED, lower=False)

    def live(since: np.ndarray) -> np.ndarray:
        start = since.astype(np.int16) + 1
        return (since != NEVER) & (start <= step) & (step < start + cycle)

    def rows(keys, langs, words, n, part=None, sums=None):
        size = len(n)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.binary()), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64()),
            pa.array(part if part is not None else [None] * size, pa.int32()), pa.array(sums if sums is not None else [None] * size, pa.binary())],
            names=["key", "lang", "word", "n", "part", "sums"])

    def emit(tally: _Tally, last: bool, names: dict | None = None):
        if (out := tally.taken(last)) is None:
            return
        _, words, n = out
        for low in range(0, len(n), 20_000):
            w = np.ascontiguousarray(words[low : low + 20_000])
            raw = w.astype(">u8").tobytes()
            step = 8 * tally.length
            known = [names[k] for k in w[:, 0].tolist()] if names is not None else [(None, None)] * len(w)
            yield rows([raw[i : i + step] for i in range(0, len(raw), step)], [x for x, _ in known], [x for _, x in known], n[low : low + 20_000])
        if names is not None:
            names.clear()

    def scan(batches):
        *reached, summed = [np.frombuffer(zlib.decompress(t), np.uint8) for t in told]
        longer = {k: _Tally(k, settings.held) for k in lengths if k > 1}
        singles, names = _Tally(1, settings.held), {}
        totals = np.zeros(settings.slots, np.int64) if sums else None
        for batch, data, at in portions(batches, "text"):
            starts, ends, first = word_bounds(data, at, WITHIN)
            if not len(starts):
                continue
            langs = batch.column(batch.schema.get_field_index("lang"))
            row = np.repeat(np.arange(len(at) - 1), np.diff(first))
            words = mixed(hash_words(data, starts, ends, table)[0] ^ _lang_hash(langs, tongues)[row])
            if 1 in lengths:
                keys, where, n = np.unique(words, return_index=True, return_counts=True)
                singles.put(keys, keys[:, None], n)
                for key, i in zip(keys.tolist(), where.tolist()):
                    if key not in names:
                        names[key] = (langs[int(row[i])].as_py(), _LOWER[data[starts[i] : ends[i]]].tobytes().decode("utf-8", "replace"))
                yield from emit(singles, False, names)
            if not longer and not sums or len(words) < 2:
                continue
            piece = np.cumsum(ENDS[data])[starts]
            joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
            since = reached[0][words & mask]
            if not (since != NEVER).any():
                continue
            # ``left``: first words of the phrases of this length whose parts have both reached the threshold
            left = np.flatnonzero(joined & (since[1:] != NEVER) & (since[:-1] != NEVER))
            start = np.maximum(since[left], since[left + 1])
            run = _runs(words, left, 2)
            slot = run & mask
            if sums:
                totals += np.bincount(slot[live(start)].astype(np.int64), minlength=settings.slots)
            ready = summed[slot]
            left, run, slot, start = (x[ready != NEVER] for x in (left, run, slot, np.maximum(start, ready)))
            for k in range(2, settings.longest + 1):
                if k in longer:
                    on = live(start)
                    if on.any():
                        longer[k].add(run[on], words[left[on, None] + np.arange(k)])
                if k == settings.longest or not len(left):
                    break
                done = reached[k - 1][slot]
                left, start = left[done != NEVER], np.maximum(start, done)[done != NEVER]
                # both parts, the phrases that begin here and one word on; the last scan of any part of them counts
                next_to = np.flatnonzero(np.diff(left) == 1)
                start = np.maximum(start[next_to], start[next_to + 1])
                left = left[next_to]
                run = _runs(words, left, k + 1)
                slot = run & mask
            for tally in longer.values():
                yield from emit(tally, False)
        yield from emit(singles, True, names)
        for tally in longer.values():
            yield from emit(tally, True)
        if sums and totals.any():
            for part in range(-(-settings.slots // _RANGE)):
                block = totals[part * _RANGE : (part + 1) * _RANGE]
                if block.any():
                    # a sum cut at ``least`` reaches it with the others whenever the whole sum does
                    yield rows([None], [None], [None], [0], [part], [np.minimum(block, settings.least).astype("<u4").tobytes()])

    return scan


def _runs(words: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each of ``left`` on."""
    factors = np.random.default_rng(_RUN_SEED).integers(1, 2**64 - 1, width, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(len(left), np.uint64)
    for k in range(width):
        total += words[left + k] * factors[k]
    return mixed(total)


def _slots(slots: int):
    """(words in the phrase, slot) of each key, the slot as the scans see it."""
    def of(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            length = np.array([len(k) // 8 for k in keys], np.int32)
            slot = np.zeros(len(keys), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                words = np.frombuffer(b"".join(keys[i] for i in at), ">u8").astype(np.uint64)
                h = words if k == 1 else _runs(words, np.arange(len(at)) * k, int(k))
                slot[at] = (h & np.uint64(slots - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(slot)], names=["k", "slot"])
    return of


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of sums from several of the same range of slots."""
    total = np.zeros(len(rows["sums"].iloc[0]) // 4, np.int64)
    for block in rows["sums"]:
        total += np.frombuffer(block, "<u4")
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "sums": [np.minimum(total, 1 << 31).astype("<u4").tobytes()]})


def _dealt(documents: DataFrame, text: str, lang: str, settings: Settings) -> list[DataFrame]:
    """The shards, written once; whichever shard a row falls to, it is in one of them."""
    spark = documents.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-shards-{uuid.uuid4().hex}"
    kept = documents.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
        F.pmod(F.monotonically_increasing_id(), F.lit(settings.shards)).cast("int").alias("shard"))
    kept.write.partitionBy("shard").parquet(path)
    whole = spark.read.schema("text string, lang string, shard int").parquet(path)
    return [whole.where(F.col("shard") == j).select("text", "lang") for j in range(settings.shards)]


def count(documents: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): every word (key, lang, word, n), and every phrase of 2 words or more that occurs ``least`` times (key, n).

    A key is the hashes of the words, 8 bytes each; equal words of different languages have different keys.
    """
    shards = _dealt(documents, text, lang, settings)
    slots, cycle = settings.slots, settings.shards
    reached = [np.full(slots, NEVER, np.uint8) for _ in range(settings.longest - 1)]
    summed = np.full(slots, NEVER, np.uint8)
    partial: dict[int, list[DataFrame]] = {}
    sums = np.zeros(slots, np.int64)
    until = {1: cycle - 1}  # the last scan in which phrases of a length may still be counted; 0 stands for the sums of pairs

    step = 0
    while step <= max(until.values()):
        lengths = [k for k in range(1, settings.longest + 1) if until.get(k, -1) >= step]
        summing = until.get(0, -1) >= step
        shard = shards[step % cycle]
        made = shard.mapInArrow(
            _scan(step, [zlib.compress(t, 1) for t in (*reached, summed)], lengths, summing, settings), "key binary, lang string, word string, n long, part int, sums binary")
        pieces = stored(made, "scan")
        counts = stored(pieces.where(F.col("key").isNotNull()).groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "counts")
        for k in lengths:
            partial.setdefault(k, []).append(counts)
        if summing:
            salts = max(1, round(len(pieces.inputFiles()) ** 0.5))
            blocks = pieces.where(F.col("part").isNotNull()).select("part", "sums", F.pmod(F.xxhash64(F.input_file_name()), F.lit(salts)).alias("salt"))
            once = blocks.groupBy("part", "salt").applyInPandas(_added, "part int, sums binary")
            # a fixed number of rows: one for each range of slots
            for row in once.groupBy("part").applyInPandas(_added, "part int, sums binary").collect():
                block = np.frombuffer(row["sums"], "<u4")
                sums[row["part"] * _RANGE :][: len(block)] += block
            summed[(sums >= settings.least) & (summed == NEVER)] = step
        drop_stored(pieces)
        tables = {id(t): t for k in lengths if k < settings.longest for t in partial[k]}
        if tables:
            keys = reduce(DataFrame.unionByName, tables.values()).where(F.length("key").isin([8 * k for k in lengths if k < settings.longest]))
            often = keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least).select("key")
            place = often.mapInArrow(_slots(slots), "k int, slot long").withColumn("slot", F.col("slot") + 1)
            # a fixed number of rows: one bitmap for each range of slots and length
            bitmaps = place.groupBy("k", (F.bitmap_bucket_number("slot") - 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
            for row in bitmaps.collect():
                on = row["part"] * _RANGE + np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little"))
                table = reached[row["k"] - 1]
                table[on[table[on] == NEVER]] = step
        last = -1
        for k, table in zip([0, *range(2, settings.longest + 1)], [reached[0], summed, *reached[1:]]):
            if not (table != NEVER).any():
                break
            last = max(last, int(table[table != NEVER].max()))
            until[k] = last + cycle
        step += 1
    of = lambda lengths: reduce(DataFrame.unionByName, list({id(t): t for k in lengths for t in partial.get(k, [])}.values()))
    words = of([1]).where(F.length("key") == 8).groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
    long = [k for k in partial if k > 1]
    phrases = of(long or [1]).where(F.length("key") > 8).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)
    return stored(words, "words"), stored(phrases, "phrases")


def collocations(documents: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words; a phrase lies within a
    piece.  ``a`` is its number of occurrences, overlaps included, ``n`` the language's number of words, ``l`` and ``r``
    those of the two parts of its lowest-scoring cut (ties: the earliest), ``score`` floor(1000 * a * n / (l * r)).  A phrase
    that lies in a longer one with at least ``contained`` percent of its occurrences is left out.  Order: score and a
    descending, then the phrase by its UTF-8 bytes.

    A null text is empty, a null language is ``und``; repeated rows count each; other columns are not looked at.  A language
    without such a phrase, and an empty table, give no rows.
    """
    words, phrases = count(documents, settings, text, lang)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = stored(words.where(F.col("n") >= settings.least).select("key", "n").unionByName(phrases), "often")
    size = (F.length("key") / 8).cast("int")
    part = lambda at, k: F.substring(F.col("key"), F.lit(8) * at + 1, F.lit(8) * k)
    longest = phrases.where(size > 2).select("n", F.explode(F.array(part(F.lit(0), size - 1), part(F.lit(1), size - 1))).alias("key"))
    within = longest.groupBy("key").agg(F.max("n").alias("longer"))
    kept = phrases.join(within, "key", "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(settings.contained) * F.col("n")))
    cuts = kept.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "key", "a", "cut", part(F.lit(0), F.col("cut")).alias("front"), part(F.col("cut"), size - F.col("cut")).alias("back"))
    sided = (
        cuts.join(often.select(F.col("key").alias("front"), F.col("n").alias("l")), "front")
        .join(often.select(F.col("key").alias("back"), F.col("n").alias("r")), "back")
        .withColumn("word", F.substring("key", 1, 8))
        .join(words.select(F.col("key").alias("word"), "lang"), "word").join(totals, "lang")
    )
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    above = (F.lit(1000).cast("decimal(4,0)") * whole("a", 16)) * whole("total", 17)  # 38 digits at most
    below = whole("l", 19) * whole("r", 19)
    scored = sided.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("key").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("total").alias("total"))
    flat = best.select("key", "lang", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a")]
    # ties of the last place stay until the phrases are spelled out; the limit holds in every task before the shuffle
    first = flat.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("place") <= settings.top).drop("place")
    spelled = first.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: part(i, F.lit(1)))).alias("at", "word"))
    named = spelled.join(words.select(F.col("key").alias("word"), F.col("word").alias("name")), "word").groupBy(
        "key", "lang", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("names"))
    phrase = named.withColumn("phrase", F.array_join(F.transform("names", lambda x: x["name"]), " "))
    return phrase.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))).where(
        F.col("rank") <= settings.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
