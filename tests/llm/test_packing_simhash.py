import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from fidelis.llm import packing, simhash

DOCS = "doc_id long, text string, sequence_id string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts], DOCS)


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 3 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "two Words", "É É é", "x" * 50_000]
    for _ in range(25):
        base = list(rng.choice(words, 400))
        texts.append(" ".join(base))
        for k in range(4):
            now = list(base)
            for p in rng.integers(0, 400, k):
                now[p] = "changed"
            texts.append("  ".join(now).upper() if k == 1 else " ".join(now))
    texts += [texts[20]] * 5
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(rows(spark, enumerate(texts))).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    comp = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_crowded_cell_is_whole():
    rng = np.random.default_rng(5)
    centre = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(600)], np.uint64))
    node = np.arange(len(fp))
    edges = [e for u, v in simhash._forest(fp, node, 3) for e in zip(u.tolist(), v.tolist(), strict=True)]
    assert len(edges) < len(fp)
    comp = {i: i for i in node.tolist()}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for u, v in edges:
        assert (int(fp[u]) ^ int(fp[v])).bit_count() <= 3
        comp[max(find(u), find(v))] = min(find(u), find(v))
    want = brute_groups(dict(enumerate(map(int, fp))))
    assert {i: find(i) for i in comp} == want


def test_bound_never_exceeds_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) <= np.bitwise_count(a ^ b)).all()


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicate_groups(rows(spark, [])).count() == 0
    got = simhash.near_duplicate_groups(rows(spark, [(None, "a b c"), (7, "a b c"), (None, "zz")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("None", "7"), ("None", "None")]


@pytest.mark.parametrize("capacity", [16, 64])
def test_pack_round_trip(spark, capacity):
    rng = np.random.default_rng(2)
    texts = [None, "", "<|endoftext|> here", "word " * 500] + ["ab cd " * int(n) for n in rng.integers(0, 40, 200)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(rows(spark, enumerate(texts)), path, capacity=capacity, groups=8).collect()
    own = Tokenizer.from_file(path)
    by_doc, fill = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:])
        assert sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(fill) <= 1.1 * -(-total // capacity) + 1


def test_pack_empty(spark):
    assert packing.pack(rows(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(np.exp(rng.normal(6.3, 1, 20_000)).astype(int), 1, 2048)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    slots, n = packing.plan(hist, 2048)
    fill = np.zeros(n, int)
    for k, runs in slots.items():
        assert sum(m * c for _, m, c, _ in runs) == hist[k]
        for first, m, c, _ in runs:
            fill[first : first + m] += k * c
    assert fill.max() <= 2048 and n <= 1.02 * -(-lengths.sum() // 2048)


def test_simhash_links_through_rows_without_ids(spark, monkeypatch):
    """Fingerprints 0, 7 and 63: the middle one belongs to a row without doc_id alone, and links the others."""
    prints = spark.createDataFrame([(1, 0), (None, 7), (3, 63), (4, 2**62 - 1), (None, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words_in: prints)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_groups(prints).collect()}
    assert got == {(1, f"{0:016x}"): 1, (None, f"{7:016x}"): 1, (3, f"{63:016x}"): 1, (4, f"{2**62 - 1:016x}"): 4, (None, "f" * 16): 4}


def test_ranks_need_no_broadcast(spark):
    texts = [(i, "some words here " * (i % 7)) for i in range(60)]
    df = rows(spark, texts).repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    a, b = (packing.pack(df, path, capacity=32, broadcast_rows=n) for n in (200_000, 0))
    assert "BroadcastHashJoin" not in b._jdf.queryExecution().optimizedPlan().toString()
    for got in (a, b):
        by_seq = {}
        for r in got.collect():
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by_seq.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 32
