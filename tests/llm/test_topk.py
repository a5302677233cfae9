import duckdb
import numpy as np
from pyspark.sql import functions as F

from fidelis.llm import queries, topk


def test_bound_holds():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 50)), rng.normal(size=(30, 50))
    true = ((q[:, None] - x[None]) ** 2).sum(-1)
    for s in (1, 4, 16, 50, 64):
        a, b = topk.segment_features(q, s), topk.segment_features(x, s)
        assert (((a[:, None] - b[None]) ** 2).sum(-1) <= true + 1e-9).all()


def test_search_against_scan():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (700, 12))
    ids = rng.permutation(5000)[:700]
    got = list(zip(*topk.search(ids[:50], x[:50], ids, x, 7, step=16), strict=True))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    for i, v in rows[:50]:
        assert [(b, s) for a, b, s in got if a == i] == topk.linear_scan(iter(rows), v, i, 7, 1.0)


def test_bounds_prune_where_vectors_differ_in_their_segments():
    """Clustered vectors: each level leaves less, the last a small share; the products of what is left are as by the scan."""
    rng = np.random.default_rng(2)
    centres = np.repeat(rng.normal(size=(40, 8)), 8, axis=1)
    x = np.floor(64 * (centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 64)))).astype(np.int64)
    q = x[:60]
    score = q @ x.T
    score[np.arange(60), np.arange(60)] = -(2**40)
    bars = np.sort(score, axis=1)[:, -20].astype(float)
    coarse, middle, fine = topk.survivors(q, x, bars)
    assert fine <= middle <= coarse < 0.5 and fine < 0.1
    ids = np.arange(3000)
    got = topk.search(ids[:60], q, ids, x, 20)
    for i in range(0, 60, 7):
        want = sorted(zip((-score[i]).tolist(), ids.tolist(), strict=True))[:20]
        assert [(-s, j) for j, s in zip(got[1][got[0] == i].tolist(), got[2][got[0] == i].tolist(), strict=True)] == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 0.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (1, [0.5, 0.5]), (5, [1.0]), (100, [2.0]), (120, []), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect())
    s = 64 * 32 + 128 * 32
    assert got == [(0, 1, 1, s), (0, 2, 3, s), (0, 3, 3, s), (100, 1, 5, 128 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op1_segment_topk"])
    got = queries.op1_segment_topk(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
