"""Exact substring de-duplication: repeated word windows, found by FM-indexes over shards.

Every window of ``window`` words holds a minimizer: its word group of ``gram`` words with the smallest hash.
Consecutive windows with the same minimizer occurrence form a stretch, and equal windows always lie in
stretches with equal minimizer, so shards are made by minimizer and no pair of equal windows is split.

1. Every document is cut into stretches (minimizer, identity of the stretch's text, place). Equal stretches
   of one task's documents collapse to the earliest; the others' windows all occur earlier.
2. By minimizer and text: equal stretches of different tasks collapse likewise. What stands alone under its
   minimizer repeats nowhere. The rest, each distinct text once, is asked for.
3. Documents give the asked texts, which are gathered by minimizer into shards of bounded size. A shard gets
   a compressed FM-index; its texts are streamed against it, right to left, for matching statistics. Where
   the match reaches ``window`` words, its suffix interval's least place is the earliest occurrence.
4. Documents are joined with their marked windows and the words under them are removed.

Stretches under a crowded minimizer are taken apart into single windows, which collapse to the earliest within a task's
documents, are dealt by the window and settled by their minimum. Equal texts and single windows are told by
two 64-bit hashes, the minimizer's and their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lean, persist_table
from .fmindex import FMIndex

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POSITION = np.uint64((1 << 24) - 1)
#: Words of a shard's texts after which it is closed, and distinct stretches that make a minimizer crowded.
SHARD_WORDS = 200_000
CROWDED = 400
#: Words of documents whose stretches, or whose asked texts, are held at once.
_WORDS_AT_ONCE = 1_000_000
MARK, ASK, ASK_APART = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Hashes of any word range of a document in constant time each."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, n)
        power, self.back = np.full(n + 1, _P), np.full(n + 1, _INVERSE)
        power[0] = self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * _P)


def stretches(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, identity, first window, number of windows) of a document's stretches."""
    n = len(words)
    if n < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    rolling, places = _Rolling(words), np.arange(n - gram + 1)
    grams = rolling.ranges(places, places + gram)
    span, held = window - gram + 1, []
    for lo in range(0, n - window + 1, 1 << 23):  # places are numbered within parts, to fit beside the hash
        part = grams[lo : min(lo + (1 << 23), n - window + 1) + span - 1]
        low = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(part) - span + 1], low[span - reach :])
        held.append((low & _POSITION).astype(np.int64) + lo)
    at = np.concatenate(held)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return grams[at[first]], rolling.ranges(first, first + count - 1 + window), first, count


def _numbered(docs: DataFrame, others: list[str]) -> DataFrame:
    """(doc_id, uid, text, others): uid orders documents by doc_id; equal to it where ids are neither null nor repeated."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *others)
    ids = d.select("doc_id").groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").limit(1).count() == 0:
        return d.select("doc_id", F.col("doc_id").alias("uid"), "text", *others)
    one = d.dropDuplicates(["doc_id", "text"]).sort(F.col("doc_id").asc_nulls_last(), "text").select("*", F.monotonically_increasing_id().alias("uid"))
    return persist_table(one.select("doc_id", "uid", "text", *others), "numbered")


def _first_pass(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def solve(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, same, uid, first, count = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((first, uid, same, key))
        key, same, uid, first, count = key[order], same[order], uid[order], first[order], count[order]
        later = np.concatenate([[False], (key[1:] == key[:-1]) & (same[1:] == same[:-1])])[: len(key)]
        # a later copy needs no minimizer any more: it is dealt by its place
        key = np.where(later, _mix(uid.astype(np.uint64) * _P + first.astype(np.uint64)), key)
        arrays = [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(uid), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(later)]
        return pa.RecordBatch.from_arrays(arrays, ["key", "same", "uid", "first", "count", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                key, same, first, count = stretches(words, window, gram)
                rows.append((key, same, np.full(len(key), uid, np.int64), first, count))
                held += len(words)
                if held > _WORDS_AT_ONCE:
                    yield solve(rows)
                    rows, held = [], 0
        if rows:
            yield solve(rows)

    return docs.select("uid", "text").mapInArrow(lean(run), "key long, same long, uid long, first int, count short, later boolean")


def _by_stretch(rows: DataFrame) -> DataFrame:
    """Marks for later copies, and each distinct stretch once; dealt by minimizer and text, so copies meet and no
    minimizer gathers in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, same, uid, first, count, later = cols
            order = np.lexsort((first, uid, later, same, key))
            key, same, uid, first, count, later = (c[order] for c in (key, same, uid, first, count, later))
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (same[1:] == same[:-1]) & ~later[:-1]])
            kind = np.where(later | again, MARK, ASK).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, key, uid, first, count)], ["kind", "key", "uid", "first", "count"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last minimizer's copies may go on in the next batch
            if cut or held and held[-1][0][-1] != now[0][0]:
                yield solve([np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)])
                held = []
            held.append([c[cut:] for c in now])
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.repartition("key", "same").sortWithinPartitions("key").mapInArrow(lean(run), "kind byte, key long, uid long, first int, count short")


def _by_minimizer(rows: DataFrame) -> DataFrame:
    """Marks, and requests for the stretches whose minimizer occurs more than once.

    Occurrences are counted with partial sums and joined back, so that a hot minimizer's rows can be split; one with
    many distinct stretches has them taken apart.
    """
    dealt = _by_stretch(rows)
    asked = F.col("kind") == ASK
    often = dealt.groupBy("key").agg(F.count_if(asked).alias("texts"), F.count("*").alias("n")).where("n > 1").select("key", "texts")
    kind = F.when(asked & (F.col("texts") > CROWDED), ASK_APART).otherwise(F.col("kind")).cast("byte")
    return dealt.join(often, "key", "left").where(~asked | F.col("texts").isNotNull()).select(kind.alias("kind"), "key", "uid", "first", "count")


TEXTS = "kind byte, key long, uid long, first int, words binary"


def _texts(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(kind, key, uid, first, words): the words of the asked stretches, keyed by minimizer. Under a crowded minimizer
    single windows without words, keyed by minimizer and window: the earliest of a task's documents, marks for the others."""
    wanted = asked.groupBy("uid").agg(F.collect_list(F.struct("kind", "key", "first", "count")).alias("asks"))

    def windows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, uid, first = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((first, uid, key))
        key, uid, first = key[order], uid[order], first[order]
        later = np.concatenate([[False], key[1:] == key[:-1]])
        key = np.where(later, _mix(uid.astype(np.uint64) * _P + first.astype(np.uint64)), key)
        kind = np.where(later, MARK, ASK_APART).astype(np.int8)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (kind, key.view(np.int64), uid, first.astype(np.int32))), pa.nulls(len(key), pa.binary())], names)

    def texts(out: list[list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), ASK, np.int8)), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names)

    names = ["kind", "key", "uid", "first", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        out: list[list] = [[], [], [], []]
        size, apart, n_apart = 0, [], 0
        for batch in batches:
            asks = batch.column(2)
            kinds, keys, firsts, counts = (c.to_numpy() for c in asks.flatten().flatten())
            ends = asks.offsets.to_numpy() - asks.offsets[0].as_py()
            for i, (uid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                own = slice(ends[i], ends[i + 1])
                words = unpack.decompress(text.as_py()).split()
                kind, key, first, count = kinds[own], keys[own], firsts[own].astype(np.int64), counts[own].astype(np.int64)
                whole = kind == ASK
                for k, f, c in zip(key[whole].tolist(), first[whole].tolist(), count[whole].tolist(), strict=True):
                    found = b" ".join(words[f : f + c - 1 + window])
                    for o, v in zip(out, (k, uid, f, found), strict=True):
                        o.append(v)
                    size += len(found)
                if size > 8 << 20:
                    yield texts(out)
                    out, size = [[], [], [], []], 0
                if not whole.all():
                    key, first, count = key[~whole], first[~whole], count[~whole]
                    places = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    mine = _mix(np.repeat(key.view(np.uint64), count) * _P + _Rolling(words).ranges(places, places + window))
                    apart.append((mine, np.full(len(mine), uid, np.int64), places))
                    n_apart += len(mine)
                    if n_apart > _WORDS_AT_ONCE:
                        yield windows(apart)
                        apart, n_apart = [], 0
        if out[0]:
            yield texts(out)
        if apart:
            yield windows(apart)

    return docs.join(wanted, "uid").select("uid", "packed", "asks").mapInArrow(lean(run), TEXTS)


def repeated_windows(texts: list[list[bytes]], uid: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, first window, number of windows) of the windows in a shard's texts that also start earlier."""
    known: dict[bytes, int] = {}
    query = np.array([known.setdefault(w, len(known) + 1) for t in texts for w in [*t, b""]], np.int64)
    known.pop(b"", None)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(sizes + 1)
    query[bounds - 1] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(query)) - np.repeat(bounds - sizes - 1, sizes + 1)
    place = np.unique(uid, return_inverse=True)[1][owner] << 32 | (first[owner].astype(np.int64) + offset)
    index = FMIndex(query, int(query.max()), window, place)
    length, low, _ = index.matching_statistics(query, bounds)
    hit = np.flatnonzero(length >= window)
    hit = hit[index.least[index.run(low[hit], window)[0]] < place[hit]]
    if not len(hit):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
    return uid[owner[hit[run]]], first[owner[hit[run]]] + offset[hit[run]], np.diff(np.concatenate([run, [len(hit)]]))


def _search(texts: DataFrame, window: int) -> DataFrame:
    """(uid, first, count): the windows that start earlier; marks as they are, single windows but each's earliest, and
    what the shards' indexes find."""
    names = ["uid", "first", "count"]

    def alone(uid: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(first), pa.array(np.ones(len(uid), np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[bytes]]] = []
        size, last = 0, None

        def solve() -> pa.RecordBatch:
            found = repeated_windows([h[3] for h in held], np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), window)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))], names)

        for batch in batches:  # by kind, then by key and place
            kind = batch.column(0).to_numpy()
            key, uid, first = (c.to_numpy() for c in batch.columns[1:4])
            marked = kind == MARK
            if marked.any():
                yield alone(uid[marked], first[marked])
            at = np.flatnonzero(kind == ASK_APART)
            if len(at):
                later = key[at] == np.concatenate([[key[at[0]] if last == key[at[0]] else ~key[at[0]]], key[at[:-1]]])
                last = key[at[-1]]
                yield alone(uid[at[later]], first[at[later]])
            for i in np.flatnonzero(kind == ASK).tolist():
                if size > SHARD_WORDS and held[-1][0] != key[i]:
                    yield solve()
                    held, size = [], 0
                held.append((key[i], uid[i], first[i], batch.column(4)[i].as_py().split()))
                size += len(held[-1][3]) + 1
        if held:
            yield solve()

    return texts.repartition("key").sortWithinPartitions("kind", "key", "uid", "first").mapInArrow(lean(run), "uid long, first int, count int")


def _kept(words: list[bytes], first: np.ndarray, count: np.ndarray, window: int) -> list[bytes]:
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + count - 1 + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def _marks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, count) of each row's marks."""
    first, count = (c.to_numpy() for c in column.flatten().flatten())
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield first[at : at + n], count[at : at + n]
        at += n


def marked_documents(docs: DataFrame, window: int = 20, gram: int = 5, others: list[str] | None = None) -> DataFrame:
    """(doc_id, packed, marks): every document with its Zstandard-packed text, its repeated windows and ``others``."""
    others = others or []
    numbered = _numbered(docs, others)
    types = ", ".join(["doc_id long", "uid long", "packed binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in others)])
    carried = numbered.select("doc_id", "uid", "text", *[f.name for f in docs.schema.fields if f.name in others])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([squeeze.compress(t.as_py() or b"") for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, *batch.columns[3:]], ["doc_id", "uid", "packed", *batch.schema.names[3:]])

    packed = carried.mapInArrow(lean(pack), types)
    found = persist_table(_by_minimizer(_first_pass(numbered, window, gram)), "stretches")
    texts = _texts(packed.select("uid", "packed"), found.where(F.col("kind") != MARK), window)
    hits = persist_table(_search(texts, window), "windows")
    marks = found.where(F.col("kind") == MARK).select("uid", "first", F.col("count").cast("int").alias("count")).union(hits)
    by_doc = persist_table(marks.groupBy("uid").agg(F.collect_list(F.struct("first", "count")).alias("marks")), "marks")
    drop_table(found)
    drop_table(hits)
    return packed.join(by_doc, "uid", "left").select("doc_id", "uid", "packed", "marks", *others)


def deduplicate(docs: DataFrame, window: int = 20, gram: int = 5, keep_text: bool = False) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts earlier (smaller doc_id, or earlier in it).

    Words are what stands between ASCII white space, unchanged. Result: doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space), and with ``keep_text`` also ``text``, the kept words themselves (the
    text as it was where nothing is removed). Null text has no words. Rows repeating a doc_id and its text are one
    document with one result row; other rows of one doc_id are ordered by text; null ids come last. An empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                out: list[list] = [[], [], [], [], []]
                for doc_id, text, (first, count) in zip(part.column(0).to_pylist(), part.column(1), _marks(part.column(2)), strict=True):
                    raw = unpack.decompress(text.as_py())
                    words = raw.split()
                    kept = _kept(words, first, count, window) if len(first) else words
                    joined = b" ".join(kept)
                    row = (doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), (joined if len(first) else raw) if keep_text else None)
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    done = marked_documents(docs, window, gram).select("doc_id", "packed", "marks").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, text binary")
    return done.withColumn("text", F.col("text").cast("string")) if keep_text else done.drop("text")


def without_repeats(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """``docs`` with the columns of documents, its texts without repeated windows, ``n_chars`` counted anew.

    Rows of null or repeated doc_ids are treated as in :func:`deduplicate`. A text of which nothing is left is
    empty; the row stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts = []
                for text, (first, count) in zip(part.column(1), _marks(part.column(2)), strict=True):
                    raw = unpack.decompress(text.as_py())
                    if len(first):
                        raw = b" ".join(_kept(raw.split(), first, count, window))
                    texts.append(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), *part.columns[3:]], ["doc_id", "text", *names])

    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"__{i}" for i in range(len(own))]  # whatever the columns are called, they meet no name of ours
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    marked = marked_documents(renamed, window, gram, names).select("doc_id", "packed", "marks", *names)
    done = marked.mapInArrow(lean(run), ", ".join(["doc_id long", "text binary", *(f"{n} {fields[c]}" for c, n in zip(own, names, strict=True))]))
    done = done.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(n).alias(c) for c, n in zip(own, names, strict=True)))
    if "n_chars" in own:
        done = done.withColumn("n_chars", F.char_length("text").cast(fields["n_chars"]))
    return done.select(docs.columns)
