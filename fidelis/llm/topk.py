"""Exact top-k search by inner product through multi-resolution segment statistics.

Vectors are cut into segments; with their means m and deviations s over segments of length l, the squared
distance of q and x is at least the sum of l((m_q - m_x)^2 + (s_q - s_x)^2). As the inner product is
(|q|^2 + |x|^2 - distance^2) / 2, that bounds it from above. Coarse segments are tried first, finer ones on
what they leave, and the exact product is computed for the survivors only.

Queries and candidates are dealt in blocks to the cells of a grid, so that neither is gathered or broadcast;
every cell returns the k best of each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
#: Share of a step's pairs that survive up to which products are computed pair by pair.
_SPARSE = 0.1


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose squared distances are the lower bound: sqrt(l) times the means and deviations of the segments."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))[:-1]
    size = np.diff(np.append(edges, d)).astype(float)
    mean = np.add.reduceat(x, edges, axis=1) / size
    var = np.maximum(np.add.reduceat(x * x, edges, axis=1) / size - mean * mean, 0)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(var * size)], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**52:  # every partial sum is an exact double
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def survivors(q: np.ndarray, x: np.ndarray, bars: np.ndarray) -> list[float]:
    """For reports and tests: the share of pairs left by each level, where ``bars`` are the queries' k-th best scores."""
    out, alive = [], np.ones((len(q), len(x)), bool)
    norms = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    for s in LEVELS:
        a, b = segment_features(q.astype(float), s), segment_features(x.astype(float), s)
        distance = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        alive &= (norms - distance) / 2 + 0.5 >= bars[:, None]
        out.append(float(alive.mean()))
    return out


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the k best candidates of each query; integer rows, ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(q) or not len(x):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    step = step or min(256, max(8, 4_000_000 // len(x)))  # so that a step's bounds stay within some tens of MB
    if not x.shape[1]:
        levels = []
    else:
        qf, xf = q.astype(float), x.astype(float)
        levels = [(segment_features(qf, s), segment_features(xf, s)) for s in LEVELS]
        qn, xn = (qf * qf).sum(1), (xf * xf).sum(1)
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        mine, own = q_ids[part], q[part]
        alive, bar = np.ones((len(own), len(x)), bool), np.full(len(own), -np.inf)
        columns = np.arange(len(x))
        for n, (fq, fx) in enumerate(levels):
            a, b = fq[part], fx[columns]
            upper = a @ b.T + ((qn[part] - (a * a).sum(1)) / 2)[:, None] + ((xn[columns] - (b * b).sum(1)) / 2)[None, :]
            if len(columns) > k + 1:  # the likeliest candidates raise the bar: their k-th exact score
                likely = columns[np.argpartition(-upper, k, axis=1)[:, : k + 1]]
                got = np.einsum("ij,ikj->ik", own, x[likely])
                got = np.where(ids[likely] == mine[:, None], np.iinfo(np.int64).min, got)
                bar = np.maximum(bar, np.partition(got, 1, axis=1)[:, 1])  # k of the k + 1 are at least this
            slack = 0.5 + 1e-9 * np.abs(upper)
            alive = alive[:, columns] & (upper + slack >= bar[:, None]) if n == 0 else alive & (upper + slack >= bar[:, None])
            some = np.flatnonzero(alive.any(axis=0))
            columns, alive = columns[some], alive[:, some]
        alive &= ids[columns][None, :] != mine[:, None]
        if alive.mean() <= _SPARSE if alive.size else True:
            at, of = np.nonzero(alive)
            score = np.zeros(alive.shape, np.int64)
            for i in range(0, len(at), 65_536):
                score[at[i : i + 65_536], of[i : i + 65_536]] = np.einsum("ij,ij->i", own[at[i : i + 65_536]], x[columns[of[i : i + 65_536]]])
        else:
            score = _exact(own, x[columns])
        for i in range(len(own)):
            at = np.flatnonzero(alive[i])
            if len(at) > k:
                s = score[i, at]
                at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
            best = at[np.argsort(-score[i, at], kind="stable")][:k]  # columns ascend by id
            out.append((np.full(len(best), mine[i]), ids[columns[best]], score[i, best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _matrix(t: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    lists = t.column("v")
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]) if t.num_rows else np.empty(0)
    whole = np.floor(values.astype(float) * scale).astype(np.int64)
    return t.column("id").to_numpy(), whole.reshape(t.num_rows, len(whole) // max(1, t.num_rows))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, cell_rows: int = 65_536, cell_queries: int = 4_096, least_cells: int = 16) -> DataFrame:
    """The k largest integer inner products of every query (rows where ``is_query``) with all other rows.

    ``vectors`` has vec_id and embedding; components become floor(scale * x). Result: query_id, rank from 1,
    vec_id, score; ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components,
    and rows with a null vec_id, take no part; vectors are held only against those of their length. Candidates
    are all rows of another vec_id (rows repeating one each count); repeated query rows are searched once, by
    the smallest of their vectors. Integer products must fit a long. An empty table gives an empty result.
    """
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = good.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"), is_query.alias("q"))
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    down, across = max(least_cells, -(-n // cell_rows)), max(1, -(-n_q // cell_queries))
    queries = rows.where("q").groupBy("id", "dim").agg(F.min("v").alias("v")).select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(across)).cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    all_rows = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<long>")).alias("c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search(*_matrix(left, scale), *_matrix(right, scale), k)
        return pa.table([pa.array(f) for f in found], ["query_id", "vec_id", "score"])

    cells = queries.select("dim", "r", "c", "id", "v").groupBy("dim", "r", "c").cogroup(all_rows.select("dim", "r", "c", "id", "v").groupBy("dim", "r", "c")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def linear_scan(rows: Iterator[tuple[int, list[float]]], query: list[float], own: int, k: int, scale: float = 64.0) -> list[tuple[int, int]]:
    """The plain search, for tests: (vec_id, score) of the k best."""
    q = [int(np.floor(scale * v)) for v in query]
    scored = [(sum(a * int(np.floor(scale * b)) for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != own]
    return [(i, s) for s, i in sorted(scored, key=lambda p: (-p[0], p[1]))[:k]]
