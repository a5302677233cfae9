"""Near copies: SimHash candidates through the segment-popcount embedding, decided by exact Jaccard similarity.

The SimHash operator in the form that decides on the texts themselves. A document's set of word shingles gets a
fingerprint of ``WORDS`` times 64 bits, whose 2-bit segments are mapped to their bit counts. A cell is the count vector of
``SEGMENTS`` segments drawn at random; ``CELLS`` draws are made, so that two documents which agree in a share s of their
segments share no cell with probability (1 - s^SEGMENTS)^CELLS. Within a cell rows are held against the Manhattan
bound, then the Hamming distance and the set sizes; the pairs left are decided on the shingle sets.

Equal shingle sets collapse first. In a cell each row is linked to the first row near it, so that a large group costs
a row per member; rows with further near rows are kept, and once components are known those of different components
are tested too. So no pair of a cell goes untested that could still join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, persist_table
from .simhash import _mix, shingle_hashes, unary, wide_fingerprints

WORDS, CELLS, SEGMENTS = 6, 128, 8
#: Differing bits of the first 128 and of all, 3 to 4 standard deviations above what is expected at a similarity of 0.8.
_NEAR, _NEAR_ALL = 36, 80
#: Rows of a cell tested pairwise by shifts, and in blocks; in longer ones so many first rows are tried.
_SMALL, _LARGE, _LEADERS, _BLOCK = 64, 4096, 64, 512


def _draw() -> np.ndarray:
    """Masks (CELLS x WORDS) of the segments of each cell."""
    rng, out = np.random.default_rng(17), np.zeros((CELLS, WORDS), np.uint64)
    for row in out:
        for s in rng.choice(32 * WORDS, SEGMENTS, replace=False).tolist():
            row[s // 32] |= np.uint64(3 << 2 * (s % 32))
    return out


_MASKS = _draw()
_FACTORS = np.random.default_rng(18).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, words_in: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words_in))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have that Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def cell_keys(prints: np.ndarray) -> Iterator[np.ndarray]:
    """Each cell's key of every row of ``prints`` (rows x WORDS)."""
    counts = unary(prints)
    for i, mask in enumerate(_MASKS):
        yield _mix(((counts & mask) * _FACTORS).sum(axis=1, dtype=np.uint64), i)


def _sets(docs: DataFrame, words_in: int) -> DataFrame:
    """(doc_id, k0, k1, n, prints): a hash of the shingle set, its size and its fingerprint (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, some, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                some.append(shingle_set(text.as_py(), words_in))
                held += len(some[-1])
                if held < 200_000 and i + 1 < batch.num_rows:
                    continue
                marks = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in some], np.uint64).view(np.int64)
                prints = wide_fingerprints(some, WORDS)
                packed = [p.tobytes() if len(s) else None for s, p in zip(some, prints, strict=True)]
                cols = [batch.column(0).slice(first, len(some)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([len(s) for s in some], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k0", "k1", "n", "prints"])
                first, some, held = i + 1, [], 0

    return docs.mapInArrow(lean(run), "doc_id long, k0 long, k1 long, n long, prints binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first, sorted column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last run may go on in the next batch
        if held and (cut or held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in now]
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _close(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Which of the rows (size n, words of the fingerprint a; m, b) may have the similarity: sizes, the bound, the exact distance."""
    ok = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    ok &= sum(np.bitwise_count(unary(x) ^ unary(y)).astype(np.int16) for x, y in zip(a, b, strict=True)) <= most
    return ok & (sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b, strict=True)) <= most)


def _first_near(n: np.ndarray, fp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one long cell: rows linked to the first row near them, those rows, and the rows with further near rows."""
    k = len(n)
    head, more = np.full(k, -1), np.zeros(k, bool)
    if k <= _LARGE:
        for j in range(0, k, _BLOCK):
            hi = min(j + _BLOCK, k)
            at = np.arange(j, hi)
            near = _close(n[:hi, None], n[None, j:hi], fp[:, :hi, None], fp[:, None, j:hi], similarity, _NEAR) & (np.arange(hi)[:, None] < at)
            first = near.argmax(axis=0)
            found = np.flatnonzero(near.any(axis=0))
            head[at[found]] = first[found]
            near[first[found], found] = False
            more[:hi] |= near.any(axis=1)
            more[j:hi] |= near.any(axis=0)
    else:
        more[:] = True
        left = np.arange(k)
        for _ in range(_LEADERS):
            if len(left) < 2:
                break
            near = _close(n[left[0]], n[left[1:]], fp[:, left[0]], fp[:, left[1:]], similarity, _NEAR)
            head[left[1:][near]] = left[0]
            left = left[1:][~near]
    at = np.flatnonzero(head >= 0)
    return at, head[at], np.flatnonzero(more)


def _met_first(counts: np.ndarray, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the row pairs meet in no earlier cell than the one they are in, so that each pair is told of once."""
    first, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for i, mask in enumerate(_MASKS):
        x, y = (_mix(((counts[r[open_]] & mask) * _FACTORS).sum(axis=1, dtype=np.uint64), i) for r in (a, b))
        met = x == y
        first[open_[met]] = x[met] == cell[a[open_[met]]]
        open_ = open_[~met]
        if not len(open_):
            break
    return first


def _dealt(heads: DataFrame, words: int, others: list[str]) -> DataFrame:
    """(cell, node, n, f0.., others): a row of ``heads`` (node, n, prints, others) for each of its cells, dealt by the cell;
    with the first ``words`` of the fingerprint."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
                own = [*part.columns[:2], *(pa.array(prints[:, k].copy().view(np.int64)) for k in range(words)), *part.columns[3:]]
                for key in cell_keys(prints):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *own], names)

    names = ["cell", "node", "n", *(f"f{k}" for k in range(words)), *others]
    rows = heads.select("node", "n", "prints", *others).mapInArrow(lean(deal), ", ".join(f"{n} long" for n in names))
    return rows.repartition("cell").sortWithinPartitions("cell", "n", "node")


def _candidates(heads: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``heads`` (node, n, prints) that meet in a cell: links (u, v), and, without v, nodes u with further near rows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, n, *prints in _runs(batches):
            fp = np.stack(prints).view(np.uint64)
            starts, sizes = _bounds(cell)
            head, more, size = np.full(len(cell), -1), np.zeros(len(cell), bool), np.repeat(sizes, sizes)
            short = np.flatnonzero((size > 1) & (size <= _SMALL))
            c, m, f = cell[short], n[short], fp[:, short]
            for d in range(min(_SMALL, int(sizes.max())) - 1, 0, -1):  # the first near row comes last and stays
                same = np.flatnonzero((c[d:] == c[:-d]) & (m[:-d] >= similarity * m[d:] - 1e-9))  # rows are by rising n
                near = same[_close(m[same], m[same + d], f[:, same], f[:, same + d], similarity, _NEAR)]
                here, there = short[near + d], short[near]
                again = head[here] >= 0
                more[here[again]] = more[there[again]] = True
                more[head[here[again]]] = True
                head[here] = np.where(again, np.minimum(head[here], there), there)
            for s, k in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
                at, first, rest = _first_near(n[s : s + k], fp[:, s : s + k], similarity)
                head[s + at], more[s + rest] = s + first, True
            at = np.flatnonzero(head >= 0)
            u, v = node[at], node[head[at]]
            rest = np.unique(node[more])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.maximum(u, v), rest])), pa.concat_arrays([pa.array(np.minimum(u, v)), pa.nulls(len(rest), pa.int64())])], ["u", "v"])

    return _dealt(heads, 2, []).mapInArrow(lean(meet), "u long, v long")


def _across(heads: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of rows of ``heads`` (node, n, prints, component, shared) of one cell but two components that may have the
    similarity; ``shared``: how many of a row's shingles others have, and so the most that it has in common with any."""

    def pairs(comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(comp) < 2 or (comp == comp[0]).all():
            return
        for i in range(0, len(comp), _BLOCK):
            for j in range(i, len(comp), _BLOCK):
                a, b = np.nonzero(comp[i : i + _BLOCK, None] != comp[None, j : j + _BLOCK])
                a, b = a + i, b + j
                yield a[a < b], b[a < b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, n, *prints, comp, shared in _runs(batches):
            fp = np.stack(prints).view(np.uint64)
            counts, held, size = unary(fp.T), [], 0

            def close() -> pa.RecordBatch:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: B023
                ok = _met_first(counts, cell.view(np.uint64), a, b)  # noqa: B023
                u, v = node[a[ok]], node[b[ok]]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

            for s, k in zip(*(x.tolist() for x in _bounds(cell)), strict=True):
                for a, b in pairs(comp[s : s + k]):
                    a, b = a + s, b + s
                    both = np.minimum(shared[a], shared[b])
                    ok = both >= similarity * (n[a] + n[b] - both) - 1e-9
                    a, b = a[ok], b[ok]
                    ok = _close(n[a], n[b], fp[:, a], fp[:, b], similarity, _NEAR_ALL)
                    if ok.any():
                        held.append((a[ok], b[ok]))
                        size += int(ok.sum())
                if size > 100_000:
                    yield close()
                    held, size = [], 0
            if held:
                yield close()

    return _dealt(heads, WORDS, ["component", "shared"]).mapInArrow(lean(run), "u long, v long").where("u <> v").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, words_in: int, similarity: float, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Those of ``pairs`` (u, v) whose shingle sets have the similarity."""
    wanted = persist_table(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "wanted")
    few = wanted.count() <= broadcast_rows  # its size is checked; beyond that documents are shuffled by id

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [shingle_set(t.as_py(), words_in).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3), strict=True))
            yield batch.select(["u", "v"]).filter(pa.array([similar(a, b, similarity) for a, b in sets], pa.bool_()))

    sets = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(lean(cut), "node long, shingles binary")
    sets = persist_table(sets, "shingles")
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(lean(check), "u long, v long")


def _shared(docs: DataFrame, nodes: DataFrame, words_in: int, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(node, own): how many of each of the documents ``nodes``' shingles no other of them has; none: no row."""
    few = nodes.count() <= broadcast_rows  # its size is checked; beyond that documents are shuffled by id

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), words_in)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), node, np.int64))], ["shingle", "node"])

    wanted = nodes.select(F.col("node").alias("doc_id"))
    rows = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(lean(cut), "shingle long, node long").distinct()
    alone = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def near_groups(docs: DataFrame, words_in: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(node) of every distinct shingle set, the smallest doc_id that has it, and (node, component) of the linked ones."""
    sets = persist_table(_sets(docs, words_in), "sets")
    nodes = persist_table(sets.groupBy("k0", "k1").agg(F.min("doc_id").alias("doc_id")), "nodes")
    heads = sets.where("prints is not null").join(nodes, ["doc_id", "k0", "k1"]).groupBy(F.col("doc_id").alias("node")).agg(F.first("n").alias("n"), F.first("prints").alias("prints"))
    heads = persist_table(heads, "heads")
    met = persist_table(_candidates(heads, similarity), "met")
    crowded = persist_table(met.where("v is null").select(F.col("u").alias("node")).distinct(), "crowded")
    again = heads.join(crowded, "node").join(_shared(docs, crowded, words_in), "node", "left")
    again = persist_table(again.select("node", "n", "prints", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")), "crowded")
    linked = persist_table(met.where("v is not null").distinct(), "pairs")

    def unsettled(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose ends are not yet known to be of one component."""
        named = pairs
        for c in "uv":
            named = named.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
        return named.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v").join(tested, ["u", "v"], "left_anti")

    few = F.slice(F.array_sort(F.collect_list("v")), 1, 4)  # of a row's links, one a cell at most, a few first; what they join needs no more
    tested = persist_table(linked.groupBy("u").agg(few.alias("v")).select("u", F.explode("v").alias("v")), "tested")
    links = persist_table(_verified(docs, tested, words_in, similarity), "links")
    groups = persist_table(connected_components(links), "components")
    for step in ("linked", "all"):
        if step == "linked":
            single = linked.join(crowded.withColumnRenamed("node", "u"), "u", "left_anti").union(linked.join(crowded.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
            fresh = unsettled(single.distinct())  # crowded rows' pairs are left to the next step, which bounds them better
        else:
            own = again.join(groups, "node", "left").select("node", "n", "prints", F.coalesce("component", "node").alias("component"), "shared")
            fresh = _across(own, similarity).join(tested, ["u", "v"], "left_anti")
        more = persist_table(fresh, "pairs")
        if not more.limit(1).count():
            continue
        found = persist_table(_verified(docs, more, words_in, similarity), "links")
        tested = tested.union(more)
        if found.limit(1).count():
            links = links.union(found)
            groups = persist_table(connected_components(links), "components")
    return nodes.select(F.col("doc_id").alias("node")).distinct(), groups


def keep_one(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all their columns), one of each group of near copies: that with the smallest doc_id.

    Documents are linked, transitively, whose sets of shingles of ``words_in`` lower-cased words (of fewer words: the
    whole) have a Jaccard similarity of at least ``similarity``; those without words are copies of each other. Of
    rows repeating a doc_id one stays; rows without doc_id all stay and link nothing. Every link is exact; the cells are
    drawn for similarities of 0.8 and more and leave out some of the pairs near that bound.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    nodes, groups = near_groups(own, words_in, similarity)
    kept = nodes.join(groups.where("component <> node"), "node", "left_anti").select(F.col("node").alias("doc_id"))
    named = docs.join(persist_table(kept, "kept"), "doc_id", "left_semi")
    if own.groupBy("doc_id").count().where("count > 1").limit(1).count():  # repeated ids only: one row of each
        named = named.dropDuplicates(["doc_id"])
    return named.select(docs.columns).union(docs.where("doc_id is null"))
