import math
from collections import Counter

import numpy as np
import pytest

from fidelis.llm import xent


def brute(rows, folds, target, mu):
    """The formula with plain dictionaries; the vocabulary is every word."""
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    vocab = {w for ts in tokens for w in ts}
    seqs = [[*ts, "</s>"] for ts in tokens]
    uni, big, ctx = ({(f, c): Counter() for f in (0, 1) for c in (0, 1)} for _ in range(3))
    for (i, _), f, s in zip(rows, folds, seqs, strict=True):
        c = int(i in target)
        for h, w in zip(["<s>", *s], s, strict=False):
            uni[f, c][w] += 1
            big[f, c][h, w] += 1
            ctx[f, c][h] += 1
    out = []
    for f, s in zip(folds, seqs, strict=True):
        loss = []
        for c in (1, 0):
            u, b, x = uni[1 - f, c], big[1 - f, c], ctx[1 - f, c]
            n = sum(u.values())
            p = lambda w, u=u, n=n: (u[w] + 1) / (n + len(vocab) + 2)
            loss.append(-sum(math.log((b[h, w] + mu * p(w)) / (x[h] + mu)) for h, w in zip(["<s>", *s], s, strict=False)) / len(s))
        out.append((len(s), *loss))
    return out


@pytest.mark.parametrize(("chunk", "part"), [(300, 10**6), (40, 100)])
def test_against_brute_force(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(xent, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(xent, "PART_KEYS", part)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(80)]
    weights = 1 / np.arange(1, 81)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "W1 " * 500), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3).cache()
    target = [i for i in range(0, 90, 4)]
    marks = spark.createDataFrame([(i,) for i in [*target, None, 4, 4]], "doc_id long")
    got = xent.score(df, marks, mu=5.0).collect()
    want = sorted((i, *v) for (i, _), v in zip(rows, brute(rows, [i % 2 for i, _ in rows], set(target), 5.0), strict=True))
    have = sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got)
    assert len(have) == len(want)
    np.testing.assert_allclose(np.array(have, float), np.array(want, float), rtol=1e-9)
    assert all(r.score == r.target_loss - r.background_loss for r in got)


def test_a_frequent_pair_is_asked_for_once_a_chunk():
    words = np.array([5, 9], np.uint64)
    ids = np.array([0, 1] * 500, "<u4")
    asked = list(xent.Chunk([0, 3], [400, 600], words.tobytes(), xent._squeeze(ids), 4).requests())
    assert sum(n for _, kind, n, _ in asked if kind == xent.WORD) == 2
    assert sum(n for _, kind, n, _ in asked if kind == xent.PAIR) == 3  # start a, a b, b a


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = xent.score(docs, none).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and all(math.isfinite(r.score) for r in got)
    assert xent.score(docs.limit(0), none).count() == 0
