"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased character 1-, 2- and 3-grams are hashed into buckets; a text's weights are
(1 + log count) * idf, scaled to unit length.  Document frequencies are counted over every row that may
be learned from.  The regression is trained by follow-the-regularised-leader (per-coordinate rates, L1 and
L2 penalties) on a bounded sample, ``Settings.per_language`` expected rows of each language picked by a
hash of the document id, longer texts than ``max_bytes`` left out.  One fifth of the sample is kept from the fit; on it one temperature is chosen for the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import columns_but, free_name, small_batches
from facsimile.llm.tokens import portions

ROWS = 256
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``most_languages``: more distinct labels than this are an error, not a silent cut."""

    per_language: int = 1200
    max_bytes: int = 1 << 18
    most_languages: int = 1000
    buckets: int = 1 << 13
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    seed: int = 11


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, languages)
    bias: np.ndarray
    temperature: float = 1.0


def lowered(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts in lower case; a null is empty.  Bytes that are no UTF-8 are replaced."""
    column = batch.column(batch.schema.get_field_index(text))
    try:
        return [t or "" for t in pc.utf8_lower(column.cast(pa.string())).to_pylist()]
    except pa.ArrowInvalid:
        return [(t or b"").decode("utf-8", "replace").lower() for t in column.to_pylist()]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts_of(texts: list[str], buckets: int) -> np.ndarray:
    """(texts, buckets) counts of hashed character n-grams; n-grams never span two texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts) * buckets, np.int64)
    step = 1 << 21
    owners, codes = np.repeat(np.arange(len(texts), dtype=np.int64), sizes), np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if len(codes) != len(owners):  # lone surrogates
        texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
        return counts_of(texts, buckets)
    for low in range(0, len(codes), step):
        u, who = codes[low : low + step + 2].astype(np.uint64), owners[low : low + step + 2]
        fresh = min(step, len(codes) - low)
        h = np.zeros(len(u), np.uint64)
        for n in (1, 2, 3):
            if len(u) < n:
                break
            h = h[: len(u) - n + 1] * np.uint64(0x100000001B3) + (u[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            spread = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keep = (who[: len(h)] == who[n - 1 :])[:fresh]
            cell = who[: len(h)][:fresh] * buckets + (spread[:fresh] >> np.uint64(40)).astype(np.int64) % buckets
            out += np.bincount(cell[keep], minlength=len(out))
    return out.reshape(len(texts), buckets)


def features(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, np.float32)
    seen = counts > 0
    x[seen] = 1.0 + np.log(counts[seen])
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal over sparse rows (buckets, values); the bias is a last coordinate of 1."""
    s, size = settings, settings.buckets + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def solved(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zz) <= s.l1, 0.0, w)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            at, value = np.append(at, settings.buckets), np.append(value, 1.0)
            w = solved(at)
            p = _softmax(value @ w)
            p[labels[k]] -= 1.0
            g = np.outer(value, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = solved(np.arange(size))
    return final[:-1], final[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm in [-2, 2]."""
    if not len(labels):
        return 1.0
    loss = lambda t: -float(np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())
    low, high, g = -2.0, 2.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(rows: DataFrame, text: str, buckets: int) -> tuple[int, np.ndarray]:
    """(rows, frequency by bucket) over all of ``rows``: one vector from each task, summed by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch, _, _ in portions(batches, text, ROWS):
            total += (counts_of(lowered(batch, text), buckets) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets), pa.int32()), pa.array(np.append(n, total), pa.int64())], ["bucket", "n"])

    made = rows.select(text).mapInArrow(counted, "bucket int, n bigint").where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets + 1, np.int64)
    for r in made:
        found[r["bucket"]] = r["n"]  # bucket -1 is the number of rows
    return int(found[-1]), found[:-1]


def fit(documents: DataFrame, allowed: Column, settings: Settings = Settings(), text: str = "text", language: str = "lang", identity: str = "doc_id") -> Model:
    """Fit on the rows with text and language for which ``allowed`` (a condition on the id) holds; no such rows give a model that knows no language."""
    small_batches(documents.sparkSession)
    usable = documents.where(allowed & F.col(text).isNotNull() & F.col(language).isNotNull()).select(identity, text, language)
    sizes = {r[0]: r[1] for r in usable.groupBy(language).agg(F.count(F.lit(1))).limit(settings.most_languages + 1).collect()}
    if len(sizes) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} distinct values of {language}")
    total, frequency = document_frequencies(usable, text, settings.buckets)
    idf = (np.log((1.0 + total) / (1.0 + frequency)) + 1.0).astype(np.float32)
    shares = usable.sparkSession.createDataFrame([(k, min(1.0, settings.per_language / v)) for k, v in sizes.items()], "_of string, _share double")
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), identity), F.lit(1 << 30)) / float(1 << 30)
    sample = (
        usable.where(F.octet_length(text) <= settings.max_bytes).join(F.broadcast(shares), F.col(language) == F.col("_of")).where(draw < F.col("_share"))
        .select(F.col(text).alias("_text"), F.col(language).alias("_lang"), F.pmod(F.xxhash64(F.lit(settings.seed + 1), identity), F.lit(5)).alias("_part"))
    )
    buckets = settings.buckets

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in portions(batches, "_text", ROWS):
            x = features(counts_of(lowered(batch, "_text"), buckets), idf)
            cells = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.astype(np.int32).tobytes() for c in cells], pa.binary()), pa.array([r[c].tobytes() for r, c in zip(x, cells)], pa.binary()), batch.column(1), batch.column(2)],
                ["cells", "weights", "_lang", "_part"])

    got = sample.mapInArrow(sparse, "cells binary, weights binary, _lang string, _part bigint").toArrow().combine_chunks()
    cells_of, weights_of = got.column(0).combine_chunks(), got.column(1).combine_chunks()
    langs, parts = got.column(2).to_pylist(), got.column(3).to_pylist()
    order = sorted(range(got.num_rows), key=lambda k: (langs[k], cells_of[k].as_buffer().to_pybytes(), weights_of[k].as_buffer().to_pybytes()))
    languages = sorted(set(langs))
    if not languages:
        return Model(settings, [], idf, np.zeros((buckets, 0)), np.zeros(0))
    rows = [(np.frombuffer(cells_of[k].as_buffer(), np.int32), np.frombuffer(weights_of[k].as_buffer(), np.float32)) for k in order]
    y, parts = np.array([languages.index(langs[k]) for k in order]), [parts[k] for k in order]
    learn, check = [np.flatnonzero(np.array([(part != 0) == k for part in parts])) for k in (True, False)]
    weights, bias = follow_the_leader([rows[k] for k in learn], y[learn], len(languages), settings)
    logits = np.array([rows[k][1] @ weights[rows[k][0]] + bias for k in check]).reshape(len(check), len(languages))
    return Model(settings, languages, idf, weights, bias, best_temperature(logits, y[check]))


def predict(documents: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` (its columns ``keep``, all by default) with lang_pred and score, the probability given to it.

    A null text, one without a letter, and every text under a model that knows no language get ``und`` with
    score 0.  Equal texts get equal predictions.  Columns of these names are replaced.
    """
    names, read_as = columns_but(keep or documents.columns, ("lang_pred", "score")), free_name(documents, "_read")
    schema = documents.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([*model.languages, UNDETERMINED], object)
        weights = model.weights.astype(np.float32)
        for batch, _, _ in portions(batches, read_as, ROWS):
            texts = lowered(batch, read_as)
            told = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
            best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if told.any():
                x = features(counts_of([t for t, k in zip(texts, told) if k], model.settings.buckets), model.idf)
                p = _softmax((x @ weights + model.bias) / model.temperature)
                best[told], score[told] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(table[best], pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return documents.select(*names, F.col(text).alias(read_as)).mapInArrow(predicted, schema)
