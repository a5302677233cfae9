import math

import duckdb
import pytest

from fidelis.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert len(got) == len(rows) > 0
    bad = [(g, w) for g, w in zip(got, rows, strict=True) if not all(near(x, y) for x, y in zip(g, w, strict=True))]
    assert not bad, (columns, bad[:3])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
