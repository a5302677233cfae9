"""SimHash near-duplicate groups, linked through a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 2-bit segments. The Manhattan distance between two such
count vectors never exceeds the Hamming distance of the fingerprints, so it is a lower bound that filters
candidates. The range join places every distinct fingerprint into grid cells of several subspaces: the
segments form ``radius + 3`` groups, a pair within Manhattan distance ``radius`` agrees in all segments of
at least three groups, and the cells are the count vectors of every choice of three groups. Points sharing
a cell are held against the bound, then verified exactly.

Only distinct fingerprints are joined, so exact copies cost nothing; inside a cell only a spanning forest of
the links is reported, never all pairs; a crowded cell is divided by the exact bits first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, persist_table

SEED = 42
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
#: Byte value -> eight bytes of 0 or 1, the first for the lowest bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
#: Rows of a cell compared pairwise at once; a longer cell is divided or taken in blocks.
_CELL = 64
_BLOCK = 512


def shingle_hashes(text: bytes | None, words_in: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words_in`` lower-cased words; fewer words: of the whole sequence."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_in + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[len(words) - n :].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), np.uint64, n)  # noqa: B905


def _bit_totals(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(array x 64) how many hashes of each array, one after the other and none empty, have each bit."""
    rows = hashes.view(np.uint8).reshape(-1, 8)
    first = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)  # a byte holds the count of 255 rows
    owner = np.cumsum(pieces) - pieces
    which = np.repeat(np.arange(len(sizes)), pieces)
    cuts = first[which] + (np.arange(len(which)) - owner[which]) * 255
    counts = np.stack([np.add.reduceat(_SPREAD[rows[:, k]], cuts) for k in range(8)], axis=1).astype("<u8").view(np.uint8).reshape(len(cuts), 64)
    return np.add.reduceat(counts.astype(np.int64), owner, axis=0)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: a bit is set if it is in over half of the hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        n = sizes[full]
        out[full] = _packed(_bit_totals(np.concatenate([hashes[i] for i in full]), n) * 2 > n[:, None])
    return out


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """(set x words) fingerprints of several words of 64 bits, of hash sets; a tie is broken by the least hash."""
    sizes = np.array([len(h) for h in sets], np.int64)
    out = np.zeros((len(sets), words), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        n, hashes = sizes[full], np.concatenate([sets[i] for i in full])
        for k in range(words):
            own = _mix(hashes, 101 + k)
            least = np.unpackbits(own[np.cumsum(n) - n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[full, k] = _packed(_bit_totals(own, n) * 2 + least > n[:, None])
    return out


def fingerprints(docs: DataFrame, words_in: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed long; no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, some, held = [], [], 0
            for text in batch.column(1):
                some.append(shingle_hashes(text.as_py(), words_in))
                held += len(some[-1])
                if held > 500_000:
                    prints.append(_fingerprints(some))
                    some, held = [], 0
            prints.append(_fingerprints(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """The 2-bit segments' bit counts in unary (00, 01, 11), so that XOR and popcount give the Manhattan distance."""
    high = fp >> _ONE
    return ((fp | high) & _LOW) | (((fp & high) & _LOW) << _ONE)


def _masks(parts: int, unit: int) -> list[np.uint64]:
    """Masks of all choices of three of ``parts`` groups of the 64 bits, groups made of whole units."""
    edges = [round(i * (64 // unit) / parts) * unit for i in range(parts + 1)]
    group = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [np.uint64(x | y | z) for x, y, z in combinations(group, 3)]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The bound first; the exact distance of those that it leaves."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= radius
    at = np.nonzero(near)
    exact = np.bitwise_count(np.broadcast_to(a, near.shape)[at] ^ np.broadcast_to(b, near.shape)[at]) <= radius
    near[at] = exact
    return near


def _pairs_in_runs(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs among equal sorted keys whose runs are short."""
    left, right = [], []
    for d in range(1, _CELL):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        ok = same[_near(fp[same], fp[same + d], radius)]
        left.append(ok)
        right.append(ok + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _forest(fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked within one crowded cell: divided by exact bits, then in blocks."""
    parent = np.arange(len(fp))

    def unite(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """In rounds: of the pairs that still join two trees, one for each tree to be hung below a smaller root."""
        while True:
            low, high = parent[a], parent[b]
            low, high = np.minimum(low, high), np.maximum(low, high)
            open_ = np.flatnonzero(low != high)
            if not len(open_):
                return
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            hung, one = np.unique(high, return_index=True)
            yield from zip(a[one].tolist(), b[one].tolist(), strict=True)
            parent[hung] = low[one]
            while True:  # every entry points at its root again
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    kept: list[tuple[int, int]] = []
    for mask in _masks(radius + 3, 1):
        part = fp & mask
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(part)]]))
        short = np.repeat(sizes <= _CELL, sizes)
        a, b = _pairs_in_runs(part[short], fp[order][short], radius)
        kept.extend(unite(order[short][a], order[short][b]))
        for s, n in zip(starts[sizes > _CELL].tolist(), sizes[sizes > _CELL].tolist(), strict=True):
            at = order[s : s + n]
            for i in range(0, n, _BLOCK):
                for j in range(i, n, _BLOCK):
                    x, y = np.nonzero(_near(fp[at[i : i + _BLOCK], None], fp[None, at[j : j + _BLOCK]], radius))
                    x, y = at[i + x], at[j + y]
                    keep = x < y
                    kept.extend(unite(x[keep], y[keep]))
    if kept:
        a, b = np.array(kept).T
        yield node[a], node[b]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp, node) at ``radius`` or fewer differing bits, enough to connect them."""
    masks = _masks(radius + 3, 2)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            counts = unary(fp)
            for i, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(_mix(counts & mask, i).view(np.int64)), *batch.columns[:2]], ["cell", "fp", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            cell, fp, node = rows
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(cell)]]))
            short = np.repeat(sizes <= _CELL, sizes)
            a, b = _pairs_in_runs(cell[short], fp[short], radius)
            found = [(node[short][a], node[short][b])]
            for s, n in zip(starts[sizes > _CELL].tolist(), sizes[sizes > _CELL].tolist(), strict=True):
                found.extend(_forest(fp[s : s + n], node[s : s + n], radius))
            for u, v in found:
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy())
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last cell may go on in the next batch
            if cut or held and held[-1][0][-1] != now[0][0]:
                yield from solve(tuple(np.concatenate(x) for x in zip(*held, tuple(c[:cut] for c in now), strict=True)))
                held = []
            held.append(tuple(c[cut:] for c in now))
        if held:
            yield from solve(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    placed = prints.select("fp", "node").mapInArrow(lean(cells), "cell long, fp long, node long")
    return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(join), "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, words_in: int = 3, radius: int = 3) -> DataFrame:
    """Group documents (doc_id, text) whose SimHash fingerprints differ in at most ``radius`` bits, transitively.

    Result: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), a row per input
    row. Null, empty and white-space texts have fingerprint zero and link like any other. A row without doc_id links
    like any other and has its group's component_id (null if no row of the group has an id). An empty table gives an
    empty result; other columns are ignored.
    """
    prints = persist_table(fingerprints(docs, words_in), "prints")
    distinct = persist_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = connected_components(links(distinct.select("fp", F.col("fp").alias("node")), radius))
    placed = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = persist_table(placed, "placed")
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies, decided on the texts: see :mod:`.neardup`."""
    from . import neardup

    return neardup.keep_one(docs, words_in, similarity)
