"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a lower-cased run of letters) is the sum of the embeddings of its own hash and of the hashes of its
first bytes, so that unseen forms of a known stem keep their meaning.  Filters of several widths run over
the words, each keeps its largest response over the whole text, and a logistic layer joins them.

The model is fitted on a bounded sample: ``Settings.per_class`` expected rows of each label, picked by a
hash of the document id, longer texts than ``max_bytes`` left out.  One fifth of the sample is kept from
the fit and sets the scale of the score (0.5 is the cut that the class shares of all labelled rows ask
for) and one threshold by language.  Every document is scored over its whole text, in blocks of words,
inside the tasks that read it; nothing is shuffled but the sampled labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import columns_but, free_name, small_batches, stored
from facsimile.llm.tokens import LETTERS, byte_table, hash_words, portions, word_bounds

PREFIXES = (4, 5, 6)
_TABLE = byte_table(101, lower=True)
_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1 + len(PREFIXES))]


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    max_bytes: int = 1 << 18
    buckets: int = 1 << 15
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    """``thresholds``: by language; None is for every other.  Scores are sigmoid(scale * margin + shift)."""

    settings: Settings
    embeddings: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width, dim, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})


def word_codes(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): buckets of each word and its prefixes, and the first word of each row."""
    starts, ends, first = word_bounds(data, at, LETTERS)
    hashes = hash_words(data, starts, ends, _TABLE, PREFIXES)
    salted = [(h + _SALTS[k]) % np.uint64(buckets) for k, h in enumerate(hashes)]
    return np.stack(salted, axis=1).astype(np.int32) if len(starts) else np.empty((0, 1 + len(PREFIXES)), np.int32), first


def _embed(model: Model, codes: np.ndarray) -> np.ndarray:
    x = model.embeddings[codes[:, 0]]
    for k in range(1, codes.shape[1]):
        x += model.embeddings[codes[:, k]]
    return x


def _responses(model: Model, x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Filter responses at each word, (words, widths * filters); a filter that would pass the end of its row (``last``) sees zeros there."""
    parts = []
    for width, kernel in model.kernels.items():
        r = x @ kernel[0]
        for j in range(1, width):
            shifted = x[j:] @ kernel[j]
            shifted[last[: len(shifted)] < j] = 0.0  # the row ends before
            r[: len(shifted)] += shifted
        parts.append(r)
    return np.concatenate(parts, axis=1)


def _pooled(model: Model, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pooled, responses, embedded, rows): the largest responses of each row with words; ``rows`` are those rows."""
    sizes = np.diff(first)
    rows = np.flatnonzero(sizes)
    x = _embed(model, codes)
    last = np.repeat(first[1:], sizes) - 1 - np.arange(len(codes))
    r = _responses(model, x, last)
    top = np.maximum.reduceat(r, first[:-1][rows], axis=0) if len(rows) else np.empty((0, len(model.bias)), np.float32)
    return top, r, x, rows


def margins(model: Model, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classifier's margin for each row; rows without words see no response at all."""
    out = np.zeros((len(first) - 1, len(model.bias)), np.float32)
    step, sizes = 1 << 16, np.diff(first)
    if len(codes) <= step or len(sizes) > 1:
        top, _, _, rows = _pooled(model, codes, first)
        out[rows] = np.maximum(top + model.bias, 0.0)
    else:  # one long text, in blocks that overlap by the widest filter
        over, best = max(model.kernels) - 1, None
        for low in range(0, len(codes), step):
            part = codes[low : low + step + over]
            last = len(part) - 1 - np.arange(len(part))
            # the overlap's own responses belong to the next block, where their filters see all their words
            top = _responses(model, _embed(model, part), last)[:step].max(axis=0)
            best = top if best is None else np.maximum(best, top)
        out[0] = np.maximum(best + model.bias, 0.0)
    return out @ model.dense + model.offset


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-8)


def train(texts: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Fit on ``texts`` (codes of each row's words) by mini-batches of Adam with logistic loss."""
    rng = np.random.default_rng(settings.seed)
    d, f = settings.dim, settings.filters
    total = f * len(settings.widths)
    model = Model(
        settings, rng.normal(0, 0.1, (settings.buckets, d)).astype(np.float32),
        {w: rng.normal(0, (2.0 / (w * d)) ** 0.5, (w, d, f)).astype(np.float32) for w in settings.widths},
        np.zeros(total, np.float32), rng.normal(0, 0.3, total).astype(np.float32), 0.0)
    adam, offset = _Adam(settings.rate), np.zeros(1, np.float32)
    usable = np.array([k for k, t in enumerate(texts) if len(t)], int)
    for _ in range(settings.epochs if len(usable) else 0):
        for low in range(0, len(order := rng.permutation(usable)), settings.batch):
            chosen = order[low : low + settings.batch]
            codes = np.concatenate([texts[k] for k in chosen])
            first = np.concatenate([[0], np.cumsum([len(texts[k]) for k in chosen])])
            top, r, x, _ = _pooled(model, codes, first)
            active = np.maximum(top + model.bias, 0.0)
            adam.t += 1
            error = (_sigmoid(active @ model.dense + offset[0]) - labels[chosen]) / len(chosen)
            back = np.outer(error, model.dense) * (active > 0)
            hit = r == np.repeat(top, np.diff(first), axis=0)
            where = np.stack([first[:-1][:, None].repeat(total, 1)[i] + [int(h) for h in hit[a:b].argmax(axis=0)] for i, (a, b) in enumerate(zip(first[:-1], first[1:]))])
            grads_x = np.zeros_like(x)
            for g, (width, kernel) in enumerate(model.kernels.items()):
                part = slice(g * f, (g + 1) * f)
                at, err = where[:, part], back[:, part]
                grad = np.zeros_like(kernel)
                for j in range(width):
                    ok = at + j < first[1:][:, None]
                    place, e = np.minimum(at + j, len(x) - 1), err * ok
                    grad[j] = np.einsum("bfd,bf->df", x[place], e)
                    np.add.at(grads_x, place.ravel(), (e[:, :, None] * kernel[j].T[None]).reshape(-1, d))
                adam.step(f"k{width}", kernel, grad)
            touched = np.flatnonzero(np.abs(grads_x).sum(axis=1))
            flat, back_to = np.unique(codes[touched].ravel(), return_inverse=True)
            grad = np.zeros((len(flat), d), np.float32)
            np.add.at(grad, back_to.ravel(), np.repeat(grads_x[touched], codes.shape[1], axis=0))
            adam.step("bias", model.bias, back.sum(axis=0).astype(np.float32))
            adam.step("dense", model.dense, (active.T @ error).astype(np.float32))
            adam.step("offset", offset, np.array([error.sum()], np.float32))
            adam.step("embeddings", model.embeddings, grad, flat)
            model.offset = float(offset[0])
    return model


def calibrate(model: Model, margin: np.ndarray, labels: np.ndarray, languages: list[str | None], weight: np.ndarray) -> None:
    """Scale the margins by weighted logistic regression, then set for each language the cut with fewest weighted errors."""
    if len(margin) and 0 < labels.sum() < len(labels):
        spread = float(np.std(margin)) or 1.0
        z, a, b = margin / spread, 1.0, 0.0
        for _ in range(300):
            e = weight * (_sigmoid(a * z + b) - labels)
            a, b = a - 0.5 * (float(np.sum(e * z) / weight.sum()) + 0.001 * a), b - 0.5 * float(np.sum(e) / weight.sum())
        model.scale, model.shift = max(a, 1e-3) / spread, b
    scores = score_of(model, margin)
    groups = {None: np.arange(len(labels))} | {lang: np.array([k for k, x in enumerate(languages) if x == lang]) for lang in set(languages) - {None}}
    for lang, rows in groups.items():
        if len(rows) < 20 or not 0 < labels[rows].sum() < len(rows):
            continue
        s, y, w = scores[rows], labels[rows], weight[rows]
        cuts = np.concatenate([[0.0], np.sort(s), [1.0]])
        middle = (cuts[:-1] + cuts[1:]) / 2
        errors = [float((w * ((s >= c) != y)).sum()) for c in middle]
        best = np.flatnonzero(np.isclose(errors, min(errors)))
        model.thresholds[lang] = float(middle[best[len(best) // 2]])


def score_of(model: Model, margin: np.ndarray) -> np.ndarray:
    return _sigmoid(model.scale * margin.astype(np.float64) + model.shift)


def sampled_labels(labels: DataFrame, allowed: Column, settings: Settings, identity: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(identity, _label) of the sampled rows, and how many rows each label has in all.

    An id with several labels takes the largest.  A row is picked when a hash of its id falls below the
    share that its label needs, so the number of rows is ``per_class`` in expectation at every size.
    """
    known = labels.where(allowed & F.col(identity).isNotNull() & F.col(label).isin(0, 1)).groupBy(identity).agg(F.max(label).alias("_label"))
    counts = {int(r["_label"]): r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, settings.per_class / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), identity), F.lit(1 << 30)) / float(1 << 30)
    cut = F.when(F.col("_label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    return known.where(draw < cut), counts


def fit(documents: DataFrame, labels: DataFrame, allowed: Column, settings: Settings = Settings(), text: str = "text",
        identity: str = "doc_id", label: str = "toxic", language: str = "lang") -> Model:
    """Fit on rows of ``labels`` for which ``allowed`` (a condition on the id) holds.  Without both labels the model gives 0."""
    small_batches(documents.sparkSession)
    picked, counts = sampled_labels(labels, allowed, settings, identity, label)
    chosen = stored(picked, "toxic-sample")
    rows = (
        documents.select(identity, F.col(text).cast("binary").alias("_text"), F.col(language).alias("_lang"))
        .where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= settings.max_bytes).join(chosen, identity)
        .select("_text", "_lang", "_label", F.pmod(F.xxhash64(F.lit(settings.seed + 1), identity), F.lit(5)).alias("_part"))
    )
    buckets = settings.buckets

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in portions(batches, "_text"):
            codes, first = word_codes(data, at, buckets)
            packed = pa.array([codes[a:b].astype(np.uint16 if buckets <= 1 << 16 else np.uint32).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(1), batch.column(2), batch.column(3)], ["codes", "_lang", "_label", "_part"])

    got = rows.mapInArrow(coded, "codes binary, _lang string, _label int, _part bigint").toArrow().combine_chunks()
    packed, languages, labels_of, parts = [got.column(k).to_pylist() if k else got.column(0).combine_chunks() for k in range(4)]
    order = sorted(range(got.num_rows), key=lambda k: (packed[k].as_buffer().to_pybytes()[:256], labels_of[k], languages[k] or "", len(packed[k].as_buffer())))
    if len(set(labels_of)) < 2:
        return Model(settings, np.zeros((buckets, settings.dim), np.float32), {1: np.zeros((1, settings.dim, 1), np.float32)}, np.zeros(1, np.float32), np.zeros(1, np.float32), -30.0)
    texts = [np.frombuffer(packed[k].as_buffer(), np.uint16 if buckets <= 1 << 16 else np.uint32).reshape(-1, 1 + len(PREFIXES)) for k in order]
    y = np.array([labels_of[k] for k in order], np.float32)
    languages = [languages[k] for k in order]
    kept = np.array([parts[k] != 0 for k in order])
    learn, check = np.flatnonzero(kept), np.flatnonzero(~kept)
    model = train([texts[k] for k in learn], y[learn], settings)
    weight = np.array([counts[int(v)] / max(1, int((y == v).sum())) for v in y])
    margin = np.array([margins(model, texts[k], np.array([0, len(texts[k])]))[0] for k in check])
    calibrate(model, margin, y[check], [languages[k] for k in check], weight[check])
    return model


def score(documents: DataFrame, model: Model, text: str = "text", language: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``documents`` (its columns ``keep``, all by default) with score (0 to 1) and toxic: whether it reaches the threshold of the row's language.

    The language only picks the threshold, never moves the score; an unknown or null one takes the common
    threshold.  Null, empty and wordless texts get the score of a text without any response.  Equal texts
    get equal scores.  Columns named score and toxic are replaced.
    """
    names = columns_but(keep or documents.columns, ("score", "toxic"))
    bytes_of = free_name(documents, "_bytes")
    schema = documents.select(*names).schema.add("score", "double")
    buckets = model.settings.buckets

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in portions(batches, bytes_of):
            codes, first = word_codes(data, at, buckets)
            values = score_of(model, margins(model, codes, first))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], [*names, "score"])

    made = documents.select(*names, F.col(text).cast("binary").alias(bytes_of)).mapInArrow(scored, schema)
    cut = F.lit(model.thresholds[None])
    if language in names:
        for lang, value in model.thresholds.items():
            cut = cut if lang is None else F.when(F.col(language) == lang, value).otherwise(cut)
    return made.withColumn("toxic", F.col("score") >= cut)


def clean(documents: DataFrame, model: Model, text: str = "text", language: str = "lang") -> DataFrame:
    """``documents`` without the rows that reach the threshold of their language.

    Columns keep their names, order and values, also those called score or toxic.  Repeated rows go or stay
    together, null and empty texts are judged like any other, an empty table stays empty.
    """
    own = {c: free_name(documents, f"_own_{c}") for c in documents.columns if c.lower() in ("score", "toxic")}
    held = score(documents.withColumnsRenamed(own), model, own.get(text, text), own.get(language, language)).where(~F.col("toxic"))
    return held.drop("score", "toxic").withColumnsRenamed({v: k for k, v in own.items()}).select(*documents.columns)
