"""Every stage and operator on nulls, empty tables, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from fidelis.llm import common, decontam, packing, queries, simhash, substring, toxicity, xent

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, marks int, uid long, key long, count long, node long, part int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (7, 0, 0), (2, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    text = "some words that stand here and are long enough to be a window of twenty words or even some more than that"
    ids = [(None, None), (None, text), (1, text), (1, text), (2, ""), (3, None), (4, " \t\n"), (5, "word " * 30_000), (2, "other"), (6, text), (7, "x" * 200_000)]
    rows = [(i, t, None, None, None, None, 1, 1, 1, 1, 1, 1) for i, t in ids]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    return sf, len(rows)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tables, empty):
    sf, n = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert (out.columns == docs.columns) == (name != "packing")
        assert (len(rows) == 0) == empty
        assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7}
        if name == "simhash" and not empty:  # the copies of 1, and one of the texts without words
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 7] or sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 2, 5, 7]


def test_operators(spark, tables):
    sf, n = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
    assert simhash.near_duplicate_groups(docs).count() == n
    assert substring.deduplicate(docs).count() == n - 1  # a repeated row is one document
    assert packing.pack(docs, queries.byte_bpe()).where("piece = 0").count() == n
    assert xent.score(docs, labels.where("quality = 1")).count() == n
    assert decontam.contaminated(docs, items).count() == 0


def test_shared_folder_is_cleaned(spark):
    t = common.persist_table(spark.range(3).select(F.col("id")), "t")
    assert t.count() == 3
    common.clean_shared(spark)
    assert not common._WRITTEN
