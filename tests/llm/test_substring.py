import hashlib

import numpy as np
import pytest

from fidelis.llm import fmindex, substring


def brute(docs, window):
    seen, out = {}, {}
    for i, text in sorted(docs):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = True
            else:
                seen[key] = 1
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def make(rng, n_docs):
    vocab = [f"w{i}" for i in range(60)]
    shared = [list(rng.choice(vocab, 35)) for _ in range(4)]
    docs = []
    for i in range(n_docs):
        words = list(rng.choice(vocab, rng.integers(0, 120)))
        for _ in range(rng.integers(0, 3)):
            p = shared[rng.integers(0, 4)]
            a = rng.integers(0, 10)
            at = rng.integers(0, len(words) + 1)
            words[at:at] = p[a : a + rng.integers(10, 35)]
        docs.append((i, "  ".join(words)))
    docs += [(n_docs, "a b c " * 40), (n_docs + 1, "a b c " * 15), (n_docs + 2, None), (n_docs + 3, ""), (n_docs + 4, "x " * 3000), (n_docs + 5, docs[3][1]), (n_docs + 6, docs[3][1])]
    return docs


@pytest.mark.parametrize("crowded", [20_000, 400, 3])
def test_dedup_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    docs = make(np.random.default_rng(4), 80)
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, marks int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(df).collect()}
    assert got == brute(docs, 20)


def test_dedup_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(25))
    rows = [(2, t), (2, t), (1, t + " z"), (None, t), (3, "b " + t), (3, "a " + t)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 26, 0), ("2", 25, 25), ("3", 26, 25), ("3", 26, 25), ("None", 25, 25)]
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_text(spark):
    t = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, "x\n" + t), (2, f"head {t}\ntail")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring.deduplicate(df, keep_text=True).collect()} == {1: "x\n" + t, 2: "head tail"}


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(12)]
    text = np.concatenate([np.append(t, 0) for t in texts])
    index = fmindex.FMIndex(text, 6, 8)
    hay = [tuple(t) for t in texts]
    queries = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(30)]
    length, low, high = index.matching_statistics(np.concatenate(queries), np.cumsum([len(q) for q in queries]))
    at = 0
    for q in queries:
        for i in range(len(q)):
            want, hits = 0, None
            for m in range(1, 9):
                p = tuple(q[i : i + m])
                n = sum(h[j : j + m] == p for h in hay for j in range(len(h) - m + 1))
                if len(p) < m or 0 in p or not n:
                    break
                want, hits = m, n
            assert length[at] == want
            if want:
                assert high[at] - low[at] == hits
            at += 1
