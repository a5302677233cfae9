import corpus_pipeline
import numpy as np
import pytest

from fidelis.llm import neardup

DOCS = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return {i for i, c in comp.items() if i == c}


def edited(rng, base, k):
    now = list(base)
    for p in rng.choice(len(base), k, replace=False):
        now[p] = f"x{rng.integers(10**6)}"
    return " ".join(now)


@pytest.mark.parametrize("small", [64, 3])
def test_stage_against_brute_force(spark, monkeypatch, small):
    """Copies on both sides of the threshold; fingerprints at 6 bits decide about half of those near it wrongly."""
    monkeypatch.setattr(neardup, "_SMALL", small)
    monkeypatch.setattr(neardup, "_LARGE", 20 if small == 3 else 4096)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(2000)]
    texts = [None, "", " \t", "One", "one", "two Words"]
    for _ in range(30):
        base = list(rng.choice(words, int(rng.integers(60, 300))))
        texts += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, max(1, int(len(base) * share))) for share in (0.01, 0.02, 0.022, 0.025, 0.04))]
    rows = list(enumerate(texts))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert {r.doc_id for r in got.collect()} == brute_kept(rows)


def test_one_large_group_makes_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, 2)) for i in range(400)]
    seen = []
    monkeypatch.setattr(neardup, "_verified", lambda docs, pairs, *a, f=neardup._verified: seen.append(pairs.count()) or f(docs, pairs, *a))
    assert [r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()] == [0]
    assert sum(seen) < 20 * len(rows)


def test_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (8, "a b c"), (9, "d"), (9, "d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neardup.keep_one(docs).collect()) == ["7", "9", "None", "None"]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_recall_by_similarity():
    """Pairs of given similarity meet in a cell and pass the bounds; some 0.8 % at 0.8 itself do not."""
    rng = np.random.default_rng(6)
    for similarity, least in ((0.8, 0.98), (0.85, 1.0), (0.9, 1.0)):
        sets = []
        for _ in range(300):
            n = int(rng.integers(50, 800))
            common = round(2 * n * similarity / (1 + similarity))
            base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            sets += [np.unique(base[:n]), np.unique(np.concatenate([base[:common], base[n : 2 * n - common]]))]
        prints = neardup.wide_fingerprints(sets, neardup.WORDS)
        met = np.zeros(300, bool)
        for key in neardup.cell_keys(prints):
            met |= key[::2] == key[1::2]
        apart = np.bitwise_count(prints[::2] ^ prints[1::2])
        found = met & (apart[:, :2].sum(axis=1) <= neardup._NEAR) & (apart.sum(axis=1) <= neardup._NEAR_ALL)
        assert found.mean() >= least
