import numpy as np
import pytest

from fidelis.llm import decontam

ITEMS = "item_id long, text string"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_lcs_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = [b"%d" % x for x in rng.integers(0, 6, rng.integers(1, 30))]
        b = [b"%d" % x for x in rng.integers(0, 6, rng.integers(0, 80))]
        assert decontam.lcs(decontam.position_masks(a), len(a), b) == brute_lcs(a, b)


def test_planted(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(3000)]
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    text = lambda n: list(rng.choice(words, n, p=p))
    rare = lambda n: [f"r{x}" for x in rng.integers(0, 10**6, n)]
    items = {i: [x for pair in zip(text(12), rare(12), strict=True) for x in pair] for i in range(30)}
    docs, want = [], set()
    for d in range(300):
        body = text(int(rng.integers(5, 300)))
        if d % 10 == 3:
            i = d // 10
            leak = list(items[i])
            if d % 20 == 3:  # a paraphrase: every fifth word of the first part changed, the answer kept
                for k in range(0, 18, 5):
                    leak[k] = f"other{k}"
            at = int(rng.integers(0, len(body)))
            body[at:at] = [w.upper() + "," for w in leak]
            want.add((d, i))
        docs.append((d, " ".join(body), 0.5))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (None, " ".join(items[7]), 0.0), (1002, "x " * 100_000, 0.0), (1003, "the cat sat here", 0.0), (3, docs[3][1], 0.0)]
    marks = [(i, " ".join(w[:18]) + ". " + " ".join(w[18:])) for i, w in items.items()] + [(100, None), (101, ""), (None, "a b"), (102, "cat sat"), (103, "sat cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine double").repartition(3)
    got = decontam.contaminated(df, spark.createDataFrame(marks, ITEMS), rank=64).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 7), (1003, 102)}
    assert len(got) == len(want) + 2
    whole = decontam.contaminated(df, spark.createDataFrame(marks, ITEMS), rank=64, items_at_once=10).collect()
    assert {(r.doc_id, r.item_id) for r in whole} == {(r.doc_id, r.item_id) for r in got}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "one two three four five six seven eight nine")], ITEMS)
    assert decontam.contaminated(docs.limit(0), marks).count() == 0
    assert decontam.contaminated(docs, marks.limit(0)).count() == 0
    assert decontam.contaminated(docs, marks).count() == 0


def test_answer_column(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "alpha x gamma y epsilon z eta theta iota k answer forty two"), (2, "alpha x gamma y epsilon z eta theta iota k"), *((i, f"filler {i} of other words") for i in range(10, 60))], "doc_id long, text string")
    marks = spark.createDataFrame([(5, body, "forty two")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.lcs) for r in decontam.contaminated(docs, marks).collect()] == [(1, 6)]


def test_paraphrases_with_other_ordinary_words(spark):
    """Every third word of an item is a word that no item has but most documents do; brute force is the rule itself."""
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(40)]
    items = {i: [f"b{x}" for x in rng.integers(0, 30, 24)] for i in range(12)}
    docs = []
    for d in range(400):
        body = list(rng.choice(common, 60)) + [f"b{x}" for x in rng.permutation(30)]
        if d % 20 == 0:
            leak = list(items[d // 20 % 12])
            for k in range(1, 16, 2):
                leak[k] = common[k]
            body[20:20] = leak
        docs.append((d, " ".join(body)))
    marks = [(i, " ".join(w[:16]) + ". " + " ".join(w[16:])) for i, w in items.items()]
    want = set()
    for d, text in docs:
        if d % 20 == 0:
            want.add((d, d // 20 % 12))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, ITEMS), rank=64).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}


def test_no_possible_passage_is_dropped():
    """A passage goes on wherever an item's rule could hold, even among words that no item has."""
    bench = decontam.Benchmark([(0, "the of and to in is was for. on as", None), (1, "alpha beta", None)], 10)
    bench.require(0.6, 8)
    ids = lambda t: np.array([bench.vocabulary.get(w, -1) for w in decontam.fold_words(t)])
    possible = lambda t: bool((bench.overlap(np.zeros(len(ids(t)), int), ids(t), 1) >= bench.need).any())
    assert possible("the x of x and x to x in x is")
    assert not possible("the x of x and x to x in x")
    assert possible("x alpha beta x") and not possible("alpha x") and not possible("x y")


def _bench(rng, n_items=12, n_words=40):
    items = [(i, " ".join(f"b{x}" for x in rng.integers(0, n_words, rng.integers(1, 40))), None) for i in range(n_items)]
    bench = decontam.Benchmark(items, 10)
    bench.require(0.6, 8)
    return bench


def _windows(n, size):
    return list(range(0, max(1, n - size // 2), size // 2))


def test_filter_against_brute_force():
    """The passages that go on are exactly those around which some item has as many words as it needs."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        bench, size = _bench(rng), 10
        docs = []
        for _ in range(8):
            body = [int(x) if x < len(bench.vocabulary) else -1 for x in rng.integers(0, 4 * len(bench.vocabulary), rng.integers(0, 400))]
            if body and rng.random() < 0.7:
                leak = [w for w in bench.own[rng.integers(len(bench.own))] if rng.random() < 0.75]
                at = int(rng.integers(len(body)))
                body[at:at] = leak
            docs.append(np.array(body, np.int32))
        want = {}
        for d, ids in enumerate(docs):
            for s in _windows(len(ids), size):
                for i, own in enumerate(bench.own):
                    around = ids[max(0, s - len(own)) : s + size + len(own)].tolist()
                    if sum(min(around.count(w), own.count(w)) for w in set(own)) >= bench.need[i]:
                        want.setdefault(d, set()).add(s)
        assert {d: set(k.tolist()) for d, k in decontam._near_passages(docs, bench, size)} == want


def test_whole_operator_against_brute_force(spark):
    """Every document, item and passage by the rule alone; the search finds all that the rule counts, in slices too."""
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(60)]
    items = {i: [*(f"b{x}" for x in rng.integers(0, 300, 22)), *rng.choice(common, 8)] for i in range(20)}
    for w in items.values():
        rng.shuffle(w)
    docs = []
    for d in range(150):
        body = list(rng.choice(common, int(rng.integers(0, 120))))
        if d % 3 == 0:
            leak = [w if rng.random() > (d % 4) / 10 else str(rng.choice(common)) for w in items[d % 20]]
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = leak
        docs.append((d, " ".join(body)))
    marks = [(i, " ".join(w[:20]) + ". " + " ".join(w[20:])) for i, w in items.items()]
    want = set()
    for d, text in docs:
        words = text.split()
        for i, own in items.items():
            for s in _windows(len(words), 10) if words else ():
                around = words[max(0, s - 30) : s + 40]
                ratio, answer = brute_lcs(own, around) / 30, brute_lcs(own[20:], around) / 10
                if ratio >= 0.8 or ratio >= 0.6 and answer >= 0.5:
                    want.add((d, i))
    df, mf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, ITEMS)
    got = sorted(decontam.contaminated(df, mf, rank=64).collect())
    assert len(want) > 30 and {(r.doc_id, r.item_id) for r in got} == want
    again = sorted(decontam.contaminated(df, mf, rank=64, items_at_once=6).collect())
    assert [(r.doc_id, r.item_id, r.start, r.lcs, round(r.cosine, 3)) for r in again] == [(r.doc_id, r.item_id, r.start, r.lcs, round(r.cosine, 3)) for r in got]


def test_paraphrase_recall(spark):
    """Rewrites of growing strength: the share of an item's words that are other words, the answer's among them."""
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(2000)]
    items = {i: list(rng.choice(words, int(rng.integers(20, 60)))) for i in range(60)}
    docs, of = [], {}
    for k, strength in enumerate((0.1, 0.2, 0.3)):
        for i, own in items.items():
            leak = list(own)
            for p in rng.choice(len(leak), round(strength * len(leak)), replace=False):
                leak[p] = str(rng.choice(words))
            body = list(rng.choice(words, 150))
            body[70:70] = leak
            of[100 * k + i] = (strength, i)
            docs.append((100 * k + i, " ".join(body)))
    marks = [(i, " ".join(w[:-10]) + ". " + " ".join(w[-10:])) for i, w in items.items()]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, ITEMS)).collect()}
    assert {(d, i) for d, i in got if of[d][1] != i} == set()
    for strength in (0.1, 0.2, 0.3):
        mine = [d for d, (s, _) in of.items() if s == strength]
        assert sum((d, of[d][1]) in got for d in mine) / len(mine) >= 0.9


def test_too_many_words_are_refused(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    with pytest.raises(ValueError, match="distinct words"):
        decontam.contaminated(docs, spark.createDataFrame([(1, "a b c d")], ITEMS), most_words=3)
