import numpy as np

from fidelis.operators.ranking import global_rank


def test_global_rank(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v)) for g, v in zip(rng.choice(3, 500, p=[0.9, 0.08, 0.02]), np.round(rng.random(500), 2), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {}
    for r in global_rank(df, ["g"], ["v"], partitions=6).collect():
        got.setdefault(r.g, []).append((r["rank"], r.v))
    for g, ranked in got.items():
        want = sorted(v for k, v in rows if k == g)
        assert sorted(ranked) == list(enumerate(want))
    flat = sorted((r["rank"], r.v) for r in global_rank(df, [], ["v"]).collect())
    assert flat == list(enumerate(sorted(v for _, v in rows)))
    assert global_rank(df.limit(0), [], ["v"]).count() == 0
