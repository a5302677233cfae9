import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bcdfglmn" for b in ("ara", "ilo", "une", "ost") for c in ("", "ta", "ro", "mi", "se")]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = {i: text(int(rng.integers(30, 200))) for i in range(300)}
    toxic = set(range(0, 300, 7))
    for i in toxic:
        docs[i] += " you idiot moron"
    items = [(0, "the capital of ruritania is strelsau and lies in the western hills. The answer is strelsau indeed"), (1, text(30))]
    leaked = {301, 302}
    docs[301] = text(60) + " " + items[0][1] + " " + text(20)
    docs[302] = text(60) + " " + items[1][1]
    docs[303] = docs[2]  # an exact copy
    near = docs[3].split()
    near[10] = "other"
    docs[304] = " ".join(near)
    passage = text(60)
    docs[305], docs[306] = text(20) + " " + passage, passage + " " + text(25)
    docs[307] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "packing":
            assert now.columns == columns
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) >= len(docs) - len(toxic) - 3
    gone = set(kept["toxicity"]) - set(kept["simhash"])
    assert 303 in gone and gone <= {303, 304}
    assert set(kept["substring"]) == set(kept["simhash"])
    assert kept["substring"][306].text == " ".join(docs[306].split()[60:]) and kept["substring"][305].text == docs[305]
    assert kept["substring"][306].n_chars == len(kept["substring"][306].text)
    assert set(kept["substring"]) - set(kept["decontamination"]) == leaked
    assert set(kept["packing"]) == set(kept["decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == set(kept["packing"])
