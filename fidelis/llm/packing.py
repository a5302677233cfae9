"""Best-fit packing of documents into fixed-length sequences by a linear grouping scheme.

Lengths are integers of at most ``capacity``, so the whole packing is decided on their histogram, whose
size is bounded by the capacity whatever the number of documents. Only that histogram reaches the driver;
documents find their slots by rank arithmetic on the executors.

1. Large lengths (above ``small``) are put in descending order into groups of equal cardinality and
   rounded up to the largest of their group.
2. The few-size problem is solved as a configuration linear program by column generation (knapsack
   pricing); each configuration is used as many whole times as the solution says.
3. Actual lengths take the slots of their group, which leaves slack.
4. What is left, and all small lengths, go by decreasing length into the tightest opening (best fit).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, persist_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _groups(hist: dict[int, int], k: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded length, [[length, count], ...] descending) for about ``k`` groups of equal cardinality."""
    total = sum(hist.values())
    size, out, room = max(1, -(-total // k)), [], 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append([length, take])
            left, room = left - take, room - take
    merged: list[tuple[int, list[list[int]]]] = []
    for size_up, runs in out:  # groups of one and the same rounded length are one size
        if merged and merged[-1][0] == size_up:
            merged[-1][1].extend(runs)
        else:
            merged.append((size_up, runs))
    return merged


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Column generation: (copies of each size, times used) of the linear program's optimum."""
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(n))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i in np.argsort(-price / np.array(sizes)):
            s, v = sizes[i], price[i]
            if v <= 1e-12:
                continue
            for lo in range(s, capacity + 1, s):  # unbounded item: each stride reads what the last wrote
                hi = min(lo + s, capacity + 1)
                got = best[lo - s : hi - s] + v
                better = got > best[lo:hi] + 1e-12
                best[lo:hi] = np.where(better, got, best[lo:hi])
                pick[lo:hi] = np.where(better, i, pick[lo:hi])
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(n), capacity
        while room and pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / step, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int).tolist(), max(0.0, float(x[j]))) for j in range(n)]


def plan(hist: dict[int, int], capacity: int, groups: int = 96, small: int | None = None) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Slots by length, as runs (first sequence, sequences, copies in each, offset of the first), and the number of sequences."""
    small = capacity // 8 if small is None else small
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    left = {k: v for k, v in hist.items() if v}
    opened = 0
    by_slack: dict[int, list[tuple[int, int]]] = {}  # slack -> runs of sequences (first, how many)

    def put(length: int, first: int, n: int, copies: int, used: int) -> None:
        slots.setdefault(length, []).append((first, n, copies, used))
        left[length] -= n * copies

    if n := left.get(capacity, 0):
        put(capacity, 0, n, 1, 0)
        opened = n
    large = {k: v for k, v in left.items() if small < k < capacity and v}
    if large:
        grouped = _groups(large, groups)
        sizes, demand = [g[0] for g in grouped], [sum(c for _, c in g[1]) for g in grouped]
        for copies, times in _configurations(sizes, demand, capacity):
            want = [(i, c) for i, c in enumerate(copies) if c]
            times = int(times + 1e-6)
            while times > 0:
                # as many sequences as have the same actual length in every slot
                taken: dict[tuple[int, int], int] = {}
                chosen: list[tuple[int, int]] = []
                for i, c in want:
                    for _ in range(c):
                        runs = grouped[i][1]
                        j = next((j for j, r in enumerate(runs) if r[1] - taken.get((i, j), 0) > 0), None)
                        if j is None:
                            break
                        taken[i, j] = taken.get((i, j), 0) + 1
                        chosen.append((i, j))
                if len(chosen) < sum(c for _, c in want):
                    break
                n = min([times, *(grouped[i][1][j][1] // t for (i, j), t in taken.items())])
                used = 0
                for (i, j), t in taken.items():
                    length = grouped[i][1][j][0]
                    put(length, opened, n, t, used)
                    used += length * t
                    grouped[i][1][j][1] -= n * t
                for i, _ in want:
                    grouped[i][1][:] = [r for r in grouped[i][1] if r[1]]
                by_slack.setdefault(capacity - used, []).append((opened, n))
                opened, times = opened + n, times - n
    by_slack.pop(0, None)
    order = sorted(by_slack)

    def add(slack: int, run: tuple[int, int]) -> None:
        if not slack:
            return
        if slack not in by_slack:
            by_slack[slack] = []
            bisect.insort(order, slack)
        by_slack[slack].append(run)

    for length in sorted((k for k, v in left.items() if v), reverse=True):
        while (count := left[length]) > 0:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                slack = order[at]
                first, n = by_slack[slack].pop()
                if not by_slack[slack]:
                    del by_slack[slack], order[at]
            else:
                slack, first = capacity, opened
                n = max(1, count // (capacity // length))
                opened += n
            copies = min(slack // length, count)
            full = min(n, count // copies)
            put(length, first, full, copies, capacity - slack)
            add(slack - copies * length, (first, full))
            if full < n:
                add(slack, (first + full, n - full))
    return slots, opened


def _encoder(path: str):
    """Text to ids of the tokenizer file; its fast twin (the same ranks) where the text names no special token."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    twin = path.removesuffix(".json") + ".tiktoken"
    if not (path.endswith("byte_bpe_50k.json") and os.path.exists(twin)):
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(twin, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """A row per piece with the checksum of its ids, the task it was made in and its rank there within its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or "") + [end_id], "<u4")
                raw, n = memoryview(ids).cast("B"), len(ids)
                first = n - (n - 1) // capacity * capacity
                lo = 0
                for piece, hi in enumerate(range(first, n + 1, capacity)):
                    for o, v in zip(out, (doc_id, piece, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), part, int(seen[hi - lo])), strict=True):
                        o.append(v)
                    seen[hi - lo] += 1
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, groups: int = 96, end_id: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its text's ids and ``end_id``; only longer ones are cut, all pieces but the first being full.
    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece. A null or empty text
    is one piece of one token. Repeated rows (also of one doc_id) are packed once each. A null doc_id stays null.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = persist_table(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = persist_table(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    hist = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(hist, capacity, groups)
    # by length: where each run's ranks begin, and the runs; its size is bounded by capacity and groups
    table = {k: (np.cumsum([0, *(n * c for _, n, c, _ in v)][:-1]), np.array(v, np.int64)) for k, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                starts, runs = shared.value[int(k)]
                i = np.searchsorted(starts, rank[at], "right") - 1
                within = rank[at] - starts[i]
                seq[at] = runs[i, 0] + within // runs[i, 2]
                off[at] = runs[i, 3] + within % runs[i, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranks = by_task.select("length", "part", "base")
    few = ranks.count() <= broadcast_rows  # a row per length and task: its size is checked; beyond that both sides are shuffled
    ranked = pieces.join(F.broadcast(ranks) if few else ranks.hint("merge"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
