"""Benchmark decontamination by latent semantic retrieval with verification.

1. Documents become ids of the benchmark's words, whose document frequencies are counted over all documents.
2. A randomised SVD of the matrix of all documents' passages, weighted sqrt(tf) idf, with the items' segments as anchoring
   rows, gives the latent space: tasks add up A'(A Q), the driver only orthonormalises a matrix of vocabulary by rank.
3. An item counts only if ``share`` of its words, or all of a short item's, are in order around a passage. Overlapping passages
   that do not have so many words of any item around them, in whatever order, go no further; that loses nothing.
4. Passages and the items' segments are compared by their cosine in the latent space; candidates are verified on the words around
   the passage: longest common subsequence with the item, and how much of the item's answer is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lean, persist_table

#: Upper-case ASCII to lower case, ASCII punctuation and control characters to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "doc_id long, item_id long, start long, cosine double, lcs int, lcs_ratio double, answer_ratio double"


def fold_words(text: bytes | str | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def answer_words(text: str, answer: str | None = None) -> list[bytes]:
    """The answer's words: the given answer, or the item's last sentence."""
    if answer:
        return fold_words(answer)
    parts = [p for p in text.replace("?", ".").replace("!", ".").split(".") if fold_words(p)]
    return fold_words(parts[-1]) if parts else []


def lcs(masks: dict, length: int, words: list) -> int:
    """Length of the longest common subsequence; ``masks``: for each word of the first sequence, its positions as bits."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def position_masks(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def numbered(words: Iterable[bytes]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(sorted(set(words)))}


def _counted(row: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word) in order, and how often each occurs."""
    both, tf = np.unique(row * size + word, return_counts=True)
    return both // size, both % size, tf


class Benchmark:
    """Items with their words, the vocabulary, segments to compare with passages, and what verification needs.

    A segment is twice as long as a passage and begins every passage's length, so that any passage that lies
    within an item lies within a segment, however long the item.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], passage_words: int, vocabulary: dict[bytes, int] | None = None) -> None:
        self.ids, self.words, self.answers = [], [], []
        for item_id, text, answer in items:
            words = fold_words(text)
            if words:
                self.ids.append(item_id)
                self.words.append(words)
                self.answers.append(answer_words(text, answer))
        self.vocabulary = numbered(w for ws in [*self.words, *self.answers] for w in ws) if vocabulary is None else vocabulary
        self.own = [[self.vocabulary[w] for w in ws] for ws in self.words]
        self.masks = [position_masks(w) for w in self.own]
        self.answer_masks = [position_masks([self.vocabulary[w] for w in ws]) for ws in self.answers]
        self.longest = max(map(len, self.words), default=0)
        cuts = [(i, w[a : a + 2 * passage_words]) for i, w in enumerate(self.own) for a in range(0, max(1, len(w) - passage_words), passage_words)]
        self.owner = np.array([i for i, _ in cuts], np.int64)
        self.segments = [w for _, w in cuts]

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, word, how often) of all segments."""
        row = np.repeat(np.arange(len(self.segments)), [len(w) for w in self.segments])
        return _counted(row, np.array([w for ws in self.segments for w in ws], np.int64), len(self.vocabulary))

    def require(self, share: float, least_words: int) -> None:
        """How many of each item's words must be there, and by word, the items with it and how often."""
        n = np.array([len(w) for w in self.own])
        self.need = np.where(n < least_words, n, np.ceil(share * n - 1e-9)).astype(np.int64)
        self.counted = [np.unique(w, return_counts=True) for w in self.own]
        rows = [(w, i, k) for i, c in enumerate(self.counted) for w, k in zip(*(x.tolist() for x in c), strict=True)]
        word, self.post_item, self.post_count = np.array(sorted(rows), np.int64).reshape(-1, 3).T.copy()
        self.post_first = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))

    def overlap(self, row: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
        """(rows x items) how many of each item's words are among the ``ids`` (-1: none's) of each row."""
        inside = ids >= 0
        row, word, tf = _counted(row[inside], ids[inside], len(self.vocabulary))
        first, sizes = self.post_first[word], self.post_first[word + 1] - self.post_first[word]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.repeat(row, sizes) * len(self.need) + self.post_item[at]
        return np.bincount(both, np.minimum(np.repeat(tf, sizes), self.post_count[at]), rows * len(self.need)).reshape(rows, -1)

    def reached(self, i: int, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the ranges of ``ids`` have as many of item i's words as it needs."""
        words, counts = self.counted[i]
        seen = np.zeros((len(ids) + 1, len(words)), np.int32)
        np.cumsum(ids[:, None] == words, axis=0, out=seen[1:])
        return np.minimum(seen[end] - seen[begin], counts).sum(axis=1) >= self.need[i]

    def verify(self, i: int, words: list[int], least_words: int) -> tuple[int, float, float]:
        """(LCS, its share of the item, share of the answer found); short items must be there word for word."""
        own, n = self.own[i], len(self.own[i])
        if n < least_words:
            whole = any(words[j : j + n] == own for j in range(len(words) - n + 1))
            return (n, 1.0, 1.0) if whole else (0, 0.0, 0.0)
        common = lcs(self.masks[i], n, words)
        a = len(self.answers[i])
        return common, common / n, lcs(self.answer_masks[i], a, words) / a if a else 1.0


def _encoded(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_words, ids): every document's words as vocabulary ids (-1: not of the vocabulary), packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pack = shared.value.get, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1):
                words = fold_words(text.as_py())
                sizes.append(len(words))
                packed.append(pack.compress(np.fromiter(map(find, words, repeat(-1)), "<i4", len(words)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, ids binary")


def _document_frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, n = zstandard.ZstdDecompressor(), 0
        df, seen = np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)  # the last place is for other words
        for batch in batches:
            for packed in batch.column(0):
                seen[:] = False
                seen[np.frombuffer(unpack.decompress(packed.as_py()), "<i4")] = True
                df += seen
                n += 1
        at = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["word", "n"])

    got = encoded.select("ids").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row per benchmark word
    df, n_docs = np.zeros(size), 0
    for word, n in got:
        if word < 0:
            n_docs = n
        else:
            df[word] = n
    return df, n_docs


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((n_docs + 1) / (df + 1)) + 0.05


REGIONS = "doc_id long, begin long, words array<int>, starts array<int>"
#: Words of documents taken together by the filter and the decomposition.
_WORDS_AT_ONCE = 100_000


def _unpacked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of each document) of some rows at a time."""
    unpack, held, size = zstandard.ZstdDecompressor(), [], 0
    for i, packed in enumerate(batch.column(column)):
        held.append(np.frombuffer(unpack.decompress(packed.as_py()), "<i4"))
        size += len(held[-1])
        if size >= _WORDS_AT_ONCE or i + 1 == batch.num_rows:
            yield i + 1 - len(held), held
            held, size = [], 0


def _pieces(docs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece of ``length`` words that each word of the documents lies in, numbered through, and each document's first."""
    n = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(-(-n // length))])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + inside // length, first


def _near_passages(docs: list[np.ndarray], bench: Benchmark, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, starts of its passages around which some item's rule could hold)."""
    reach = 2 * bench.longest + size  # what is verified with a passage lies within two neighbouring pieces of that length
    piece, first = _pieces(docs, reach)
    ids = np.concatenate(docs)
    later = ~np.isin(piece, first)  # each piece together with the next of its document
    have = bench.overlap(np.concatenate([piece, piece[later] - 1]), np.concatenate([ids, ids[later]]), int(first[-1]))
    at, item = np.nonzero(have >= bench.need)
    owner = np.searchsorted(first, at, side="right") - 1
    cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        ids, d = docs[owner[a]], int(owner[a])
        lo = np.arange(0, max(1, len(ids) - size // 2), size // 2)
        near = np.zeros(len(lo), bool)
        for p, i in zip((at[a:b] - first[d]).tolist(), item[a:b].tolist(), strict=True):
            left, right, own = p * reach, (p + 2) * reach, len(bench.own[i])
            x, y = np.searchsorted(lo, [left if p else 0, right])
            begin, end = np.maximum(lo[x:y] - own, 0), np.minimum(lo[x:y] + size + own, len(ids))
            fits = (begin >= left) & (end <= right)
            begin, end = begin[fits] - left, end[fits] - left
            near[x:y][np.flatnonzero(fits)[bench.reached(i, ids[left:right], begin, end)]] = True
        if near.any():
            yield d, lo[near]


def _passages(encoded: DataFrame, shared, size: int) -> DataFrame:
    """Regions around the passages near which an item is possible: vocabulary ids (-1: not of the vocabulary) of the
    words, and where passages start among them. Regions of neighbouring passages are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        margin = bench.longest
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for at, docs in _unpacked(batch, 1):
                for d, kept in _near_passages(docs, bench, size):
                    for run_ in np.split(kept, np.flatnonzero(np.diff(kept) > margin) + 1):
                        begin = max(0, int(run_[0]) - margin)
                        row = (batch.column(0)[at + d].as_py(), begin, docs[d][begin : int(run_[-1]) + size + margin], (run_ - begin).astype(np.int32))
                        for o, v in zip(out, row, strict=True):
                            o.append(v)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["doc_id", "begin", "words", "starts"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), REGIONS)


def _summed(row: np.ndarray, word: np.ndarray, value: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their projections): value-weighted sums of the basis over each row's words; rows are in order."""
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))[: len(row)]
    return row[heads], np.add.reduceat(basis[word] * value[:, None], heads, axis=0) if len(row) else np.empty((0, basis.shape[1]), basis.dtype)


def _back(row: np.ndarray, word: np.ndarray, value: np.ndarray, basis: np.ndarray, total: np.ndarray, step: int = 32) -> None:
    """Add A'(A basis) to ``total``, for the sparse rows A; a few rows at a time are dense in the words that they have."""
    cuts = np.searchsorted(row, np.arange(0, int(row[-1]) + 1 + step, step)).tolist() if len(row) else []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if lo < hi:
            own, at = np.unique(word[lo:hi], return_inverse=True)
            x = np.zeros((step, len(own)), basis.dtype)
            x[row[lo:hi] - k * step, at] = value[lo:hi]
            total[own] += x.T @ (x @ basis[own])


def _projected(regions: pa.Array, starts: pa.Array, size: int, idf: np.ndarray, basis: np.ndarray, step: int = 512) -> Iterator[np.ndarray]:
    """The projections of the passages in order, some at a time; weights are sqrt(tf) idf."""
    words, ends = regions.flatten().to_numpy(), regions.offsets.to_numpy() - regions.offsets[0].as_py()
    per_row = np.diff(starts.offsets.to_numpy())
    first = np.repeat(ends[:-1], per_row) + starts.flatten().to_numpy()
    last = np.minimum(first + size, np.repeat(ends[1:], per_row))
    for lo in range(0, len(first), step):
        at = first[lo : lo + step, None] + np.arange(size)
        inside = at < last[lo : lo + step, None]
        word = np.where(inside, words[np.minimum(at, len(words) - 1)], -1)
        row, where = np.nonzero(word >= 0)
        row, word, tf = _counted(row, word[row, where].astype(np.int64), len(idf))
        out = np.zeros((len(at), basis.shape[1]), np.float32)
        rows, y = _summed(row, word, (np.sqrt(tf) * idf[word]).astype(np.float32), basis)
        out[rows] = y
        yield out


def latent_basis(encoded: DataFrame, anchors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], idf: np.ndarray, size: int, rank: int, rounds: int = 1, seed: int = 11) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of all documents' passages and the anchoring segments, by randomised iteration.

    Passages are documents' words in pieces of ``size``. Segments together weigh as much as all passages. Each task adds up
    its share of A'(A Q); there are about twice as many tasks as the cluster has cores, so that what is summed
    follows the cluster and not the data.
    """
    spark = encoded.sparkSession
    width = min(rank + 16, len(idf))
    n_passages = encoded.agg(F.coalesce(F.sum(F.ceil(F.col("n_words") / size)), F.lit(0))).first()[0]
    anchor = 1.0 + n_passages / max(1, sum(int(a[0][-1]) + 1 for a in anchors if len(a[0])))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), width)))[0]
    n_blocks = 16
    edges = np.linspace(0, len(idf), n_blocks + 1).astype(int)
    shares = encoded.select("ids").coalesce(2 * spark.sparkContext.defaultParallelism)

    def times(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.shape, np.float32)
            for batch in batches:
                for _, docs in _unpacked(batch, 0):
                    ids = np.concatenate(docs)
                    row, word, tf = _counted(_pieces(docs, size)[0][ids >= 0], ids[ids >= 0], len(idf))
                    _back(row, word, (np.sqrt(tf) * idf[word]).astype(np.float32), shared.value, total)
            parts = [total[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p.as_py(), np.float32).astype(float) for p in t.column("part"))
            return pa.table([t.column("block").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

        schema = "block int, part binary"
        summed = shares.mapInArrow(lean(partial), schema).repartition(n_blocks, "block").groupBy("block").applyInArrow(add, schema)
        blocks = {r.block: np.frombuffer(r.part, np.float32) for r in summed.collect()}  # vocabulary x width numbers
        out = np.zeros(basis.shape)
        for row, word, tf in anchors:
            _back(row, word, np.sqrt(tf) * idf[word], basis, out)
        out *= anchor
        for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if b in blocks:
                out[lo:hi] += blocks[b].reshape(hi - lo, basis.shape[1])
        return out

    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _search(regions: DataFrame, bench_shared, idf: np.ndarray, basis: np.ndarray, size: int, least_cosine: float, least_words: int) -> DataFrame:
    """A row (FOUND) for each passage and item that are close in the latent space, verified."""
    row, word, tf = bench_shared.value.terms()
    segments = _unit(_summed(row, word, np.sqrt(tf) * idf[word], basis)[1]).astype(np.float32)  # no segment is empty
    latent = regions.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32), segments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = bench_shared.value
        idf, basis, segments = latent.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            doc_ids, begins, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy())).tolist()
            place = starts.flatten().to_pylist()
            at = 0
            for y in _projected(batch.column(2), starts, size, idf, basis):
                cosine = _unit(y) @ segments.T
                rows, found = np.nonzero(cosine >= least_cosine)
                closest: dict[tuple[int, int], float] = {}
                for r, i, c in zip(rows.tolist(), bench.owner[found].tolist(), cosine[rows, found].tolist(), strict=True):
                    closest[r, i] = max(c, closest.get((r, i), 0.0))
                for (r, i), c in closest.items():
                    n, s = owner[at + r], place[at + r]
                    reach = len(bench.own[i])
                    around = batch.column(2)[n].values[max(0, s - reach) : s + size + reach].to_pylist()
                    row = (doc_ids[n], bench.ids[i], begins[n] + s, c, *bench.verify(i, around, least_words))
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                at += len(y)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
            names = ["doc_id", "item_id", "start", "cosine", "lcs", "lcs_ratio", "answer_ratio"]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)

    return regions.select("doc_id", "begin", "words", "starts").mapInArrow(lean(run), FOUND)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, passage_words: int = 10, rank: int = 256, least_cosine: float = 0.5, near: float = 0.8, paraphrase: float = 0.6, answer: float = 0.5, least_words: int = 8, items_at_once: int = 2000, most_words: int = 200_000
) -> DataFrame:
    """Documents (doc_id, text) that hold items of ``benchmark`` (item_id, text, and answer where it has that column).

    Result: a row per document and item: doc_id, item_id, start (first word of the best passage), cosine, lcs,
    lcs_ratio, answer_ratio. A pair counts if the longest common subsequence holds ``near`` of the item's words, or
    ``paraphrase`` of them and ``answer`` of the answer's. Words are lower-cased (A-Z) and without ASCII punctuation.
    Items of fewer than ``least_words`` words must occur word for word; items without words or with a null item_id
    and documents without words give no rows. Repeated rows of one doc_id are one document; a null doc_id is
    reported as null. Vocabulary, frequencies and latent space are those of the whole benchmark; items are searched
    ``items_at_once``, so that what is broadcast is bounded, which changes no result. A benchmark of over
    ``most_words`` distinct words is refused. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    has_answer = "answer" in benchmark.columns
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.col("answer").cast("string").alias("answer") if has_answer else F.lit(None).cast("string").alias("answer"))
    slices = max(1, -(-rows.count() // items_at_once))

    def part(s: int, vocabulary: dict[bytes, int] | None) -> Benchmark:
        some = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s)
        return Benchmark([tuple(r) for r in some.orderBy("item_id", "text").collect()], passage_words, vocabulary)

    words: set[bytes] = set()
    for s in range(slices):
        words |= part(s, None).vocabulary.keys()
        if len(words) > most_words:
            raise ValueError(f"the benchmark has over {most_words} distinct words; divide it")
    if not words:
        return spark.createDataFrame([], FOUND)
    vocabulary = numbered(words)
    encoded = persist_table(_encoded(docs, vocabulary), "encoded")
    idf = weights(*_document_frequencies(encoded, len(vocabulary)))
    anchors = [part(s, vocabulary).terms() for s in range(slices)]
    basis = latent_basis(encoded, anchors, idf, 4 * passage_words, min(rank, len(vocabulary)))
    out = None
    for s in range(slices):
        bench = part(s, vocabulary)
        if not bench.ids:
            continue
        bench.require(min(near, paraphrase), least_words)
        shared = spark.sparkContext.broadcast(bench)
        passages = persist_table(_passages(encoded, shared, passage_words), "passages")
        best = _search(passages, shared, idf, basis, passage_words, least_cosine, least_words)
        verified = best.where((F.col("lcs_ratio") >= near) | (F.col("lcs_ratio") >= paraphrase) & (F.col("answer_ratio") >= answer))
        top = F.max(F.struct("lcs", "answer_ratio", "cosine", (-F.col("start")).alias("back"), "lcs_ratio")).alias("b")
        merged = verified.groupBy("doc_id", "item_id").agg(top)
        found = persist_table(merged.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.cosine", "b.lcs", "b.lcs_ratio", "b.answer_ratio"), "leaks")
        drop_table(passages)
        out = found if out is None else out.union(found)
    drop_table(encoded)
    return out
