"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (4 to 6 code points, lower-cased) of a text. From labelled texts
each gets the log-count ratio r of the two classes (smoothed, over documents); features whose ratio is
significant are kept, scaled by r, and a logistic regression is fitted on the scaled features by a fixed number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SIZES = (4, 5, 6)
_P = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
#: Code points handled at once.
_SPAN = 400_000


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each size the 64-bit keys of the n-grams at every position (shorter at the end)."""
    key = points.astype(np.uint64) + np.uint64(1)
    base = key
    key = key * _M
    for n in range(2, SIZES[-1] + 1):
        if len(base) < n:
            return
        key = key[: len(base) - n + 1] * _P + base[n - 1 :] * _M
        key ^= key >> np.uint64(29)
        if n in SIZES:
            yield key


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.table: np.ndarray | None = None

    def _find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a feature, and which."""
        if self.table is None:  # which buckets hold any feature
            self.table = np.zeros(1 << _TABLE_BITS, bool)
            self.table[(self.keys * _M) >> np.uint64(64 - _TABLE_BITS)] = True
        at = np.flatnonzero(self.table[(grams * _M) >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        ok = self.keys[which] == grams[at]
        return at[ok], which[ok]

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, feature) of the distinct features of each text."""
        found: list[np.ndarray] = []
        group: list[np.ndarray] = []
        first = held = 0

        def flush(end: int) -> None:
            if not group or not len(self.keys):
                return
            gap = np.full(SIZES[-1], 0x110000, np.uint32)  # no n-gram over a text's end is a feature
            owner = np.repeat(np.arange(first, end), [len(g) + len(gap) for g in group])
            hits = []
            for grams in _grams(np.concatenate([x for g in group for x in (g, gap)])):
                at, which = self._find(grams)
                hits.append(owner[at] * len(self.keys) + which)
            if hits:
                found.append(np.unique(np.concatenate(hits)))

        for i, text in enumerate(texts):
            group.append(_points(text))
            held += len(group[-1])
            if held > _SPAN:
                flush(i + 1)
                group, first, held = [], i + 1, 0
        flush(len(texts))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.concatenate(found)
        return both // len(self.keys), both % len(self.keys)

    def score(self, texts: list[str | None]) -> np.ndarray:
        docs, feats = self.present(texts)
        z = self.bias + np.bincount(docs, self.weights[feats] if len(feats) else None, minlength=len(texts))
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _document_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(texts), 200):
        own = [np.unique(np.concatenate([np.empty(0, np.uint64), *_grams(_points(t))])) for t in texts[lo : lo + 200]]
        parts.append(np.unique(np.concatenate(own), return_counts=True))
        if len(parts) >= 8:
            parts = [_merge(parts)]
    return _merge(parts) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None, max_features: int = 20_000, least_z: float = 2.5, alpha: float = 1.0, l2: float = 1.0, rounds: int = 400) -> Model:
    """Fit on labelled texts; ``prior`` is the share of label 1 where it differs from the sample's.

    Without texts of both classes nothing can be told apart, and every score is 0.
    """
    y = np.array(toxic, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.empty(0, np.uint64), np.empty(0), -np.inf)
    prior = share if prior is None else prior
    pos, neg = (_document_counts([t for t, v in zip(texts, toxic, strict=True) if v == c]) for c in (1, 0))
    keys = np.union1d(pos[0], neg[0])
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, pos[0])], q[np.searchsorted(keys, neg[0])] = pos[1], neg[1]
    p, q = p + alpha, q + alpha
    r = np.log(p / (y.sum() + 2 * alpha)) - np.log(q / ((1 - y).sum() + 2 * alpha))
    z = np.abs(r) / np.sqrt(1 / p + 1 / q)
    keep = np.flatnonzero(z >= least_z)
    keep = keep[np.argsort(-z[keep], kind="stable")[:max_features]]
    model = Model(keys[keep], r[keep], 0.0)
    docs, feats = model.present(texts)
    value = model.weights[feats]
    w, b = np.zeros(len(model.keys)), float(np.log(share / (1 - share)))
    mean, square, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        f = b + np.bincount(docs, w[feats] * value, minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(f, -500, 500))) - y
        g = np.bincount(feats, err[docs] * value, minlength=len(w)) + l2 * w
        gb = err.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.02 * (1 - t / rounds) + 0.0005
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(model.keys, model.weights * w, float(b + shift))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 2000) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``per_class`` of each class.

    The sample is the rows with the smallest hashes of doc_id; rows with a null label or doc_id take no part,
    repeated labels of one document count once, and a document labelled both ways takes no part.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    usable = usable.where("toxic = most").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    seen = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "toxic") for c in (0, 1)]
    sample = text.join(F.broadcast(picked[0].union(picked[1])), "doc_id").dropDuplicates(["doc_id"]).collect()  # at most 2 * per_class rows
    sample.sort(key=lambda r: r.doc_id)
    total = sum(seen.values())
    prior = seen.get(1, 0) / total if total and 0 < seen.get(1, 0) < total else None
    return fit([r.text for r in sample], [int(r.toxic) for r in sample], prior)


def score(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), from the whole text alone.

    Null and empty texts get the score of a text without features. A null doc_id is kept and is not held out.
    Repeated rows are scored once each; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # at most max_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose text scores under 0.5; null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part.filter(pa.array(own.score(part.column(place).to_pylist()) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
