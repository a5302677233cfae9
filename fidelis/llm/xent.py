"""Cross-entropy difference: how much more a document resembles a target corpus than the background.

Two word bigram models with the same vocabulary, order and smoothing are counted over all documents, one over
the target's, one over the others'. Documents fall into two folds (even and odd doc_id), and each is scored by the counts of the other
fold, so that no document judges itself. With Dirichlet smoothing towards smoothed unigrams,

    p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu),     p(w) = (c(w) + 1) / (N + V),

where V counts the corpus's words, the end of a document and one place for words that nobody has.
A document's score is its mean loss per token under the target model minus that under the background model.

The vocabulary is every word of the corpus, and nothing of it is held by the driver. Words and pairs are 64-bit hashes. Documents
are gathered into chunks of bounded size; a chunk asks for each of its distinct words and pairs once, with its own counts,
from the part that the hash belongs to. Parts add up the counts and answer every chunk, which then scores its
documents by itself. So a frequent pair costs a number per chunk, and what is exchanged is in proportion to the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, persist_table

#: Hashes of a document's end, a token like any other, and of what precedes its first word.
END, START = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Tokens after which a chunk of documents is closed, and keys that a part holds on average.
CHUNK_TOKENS = 1_000_000
PART_KEYS = 1_000_000
WORD, PAIR = 0, 1
CHUNKS = "chunk long, doc_ids array<long>, grps array<int>, sizes array<int>, words binary, ids binary"
ASKED = "part long, chunk long, kind byte, n long, data binary"


def _words(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(3)), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, their bytes by place, packed."""
    pack = zstandard.ZstdCompressor(level=1)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return pack.compress(b"".join(planes))


def _unsqueeze(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for t in types:
        width = np.dtype(t).itemsize
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(t).reshape(-1))
        at += n * width
    return out


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, grp): their distinct words' hashes, and every token as a number among them; a
    document of n words has n + 1 tokens, the last END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, rows = 0, 0, []

        def close() -> pa.RecordBatch:
            words, ids = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
            chunk = TaskContext.get().partitionId() << 32 | n
            lists = [pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int32())), pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int32()))]
            packed = [pa.array([b], pa.binary()) for b in (words.tobytes(), _squeeze(ids.astype("<u4")))]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, *packed], ["chunk", "doc_ids", "grps", "sizes", "words", "ids"])

        for batch in batches:
            for doc_id, text, grp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append((doc_id, grp, np.append(_words(text.as_py()), END)))
                held += len(rows[-1][2])
                if held >= CHUNK_TOKENS:
                    yield close()
                    n, held, rows = n + 1, 0, []
        if rows:
            yield close()

    return docs.mapInArrow(lean(run), CHUNKS)


class Chunk:
    """A chunk's tokens, and its distinct words and pairs in the order in which parts are asked for them."""

    def __init__(self, grps: list[int], sizes: list[int], words: bytes, ids: bytes, parts: int) -> None:
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.grps = np.array(grps, np.int64)
        hashes = np.append(np.frombuffer(words, np.uint64), START)
        self.word = _unsqueeze(ids, int(self.sizes.sum()), "<u4")[0].astype(np.int64)
        self.history = np.concatenate([[len(hashes) - 1], self.word[:-1]])
        self.history[np.cumsum(self.sizes)[:-1]] = len(hashes) - 1
        distinct, self.pair = np.unique(self.history * len(hashes) + self.word, return_inverse=True)
        pairs = _mix(hashes[distinct // len(hashes)] * _P + hashes[distinct % len(hashes)])
        self.asked = []
        for hashed, token in ((hashes[:-1], self.word), (pairs, self.pair)):
            part = (_mix(hashed + _P) >> np.uint64(24)).astype(np.int64) % parts
            self.asked.append((hashed, part, np.lexsort((hashed, part)), token))

    def requests(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(part, kind, number, data) for each part that holds some of the words or pairs: hashes and own counts."""
        for kind, (hashed, part, order, token) in enumerate(self.asked):
            counts = np.bincount(token * 4 + self.grps[self.doc], minlength=4 * len(hashed)).reshape(-1, 4).astype("<u4")[order]
            hashed, part = hashed[order], part[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            gaps = np.diff(hashed, prepend=np.uint64(0))
            gaps[first] = hashed[first]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                yield int(part[a]), kind, b - a, _squeeze(gaps[a:b], *counts[a:b].T)

    def answered(self, kind: int, answers: list[tuple[int, int, bytes]]) -> np.ndarray:
        """Counts by fold and class of each word or pair, from the answers (part, number, data)."""
        hashed, _, order, _ = self.asked[kind]
        out = np.empty((len(hashed), 4), np.int64)
        out[order] = np.concatenate([np.stack(_unsqueeze(data, n, *["<u8"] * 4), axis=1) for _, n, data in sorted(answers)]).astype(np.int64)
        return out


def _requests(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, *rest = (batch.column(k)[i].as_py() for k in range(5))
                rows = list(Chunk(*rest, parts).requests())
                cols = zip(*rows, strict=True)
                part, kind, n, data = (pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int8(), pa.int64(), pa.binary()), strict=True))
                yield pa.RecordBatch.from_arrays([part, pa.array([chunk] * len(rows)), kind, n, data], ["part", "chunk", "kind", "n", "data"])

    return chunks.select("chunk", "grps", "sizes", "words", "ids").mapInArrow(lean(run), ASKED)


def _answers(requests: DataFrame) -> DataFrame:
    """Each request's keys with the counts of all chunks; and per part, without a chunk, how many different words it holds."""

    def meet(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {f: [] for f in ("part", "chunk", "kind", "n", "data")}

        def add(*row) -> None:
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)

        part = t.column("part")[0].as_py()
        for kind in (WORD, PAIR):
            some = t.filter(pa.compute.equal(t.column("kind"), kind))
            if not some.num_rows:
                continue
            sizes, keys, counts = some.column("n").to_pylist(), [], []
            for n, data in zip(sizes, some.column("data"), strict=True):
                gaps, *own = _unsqueeze(data.as_py(), n, "<u8", *["<u4"] * 4)
                keys.append(np.cumsum(gaps, dtype=np.uint64))
                counts.append(np.stack(own, axis=1))
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            own = np.concatenate(counts)
            total = np.stack([np.bincount(at, own[:, i], len(known)) for i in range(4)], axis=1).astype("<u8")
            begin = 0
            for n, chunk in zip(sizes, some.column("chunk").to_pylist(), strict=True):
                add(part, chunk, kind, n, _squeeze(*total[at[begin : begin + n]].T))
                begin += n
            if kind == WORD:
                add(part, None, kind, len(known), None)
        types = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    return requests.groupBy("part").applyInArrow(meet, ASKED)


def score(docs: DataFrame, target: DataFrame, mu: float = 50.0, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of ``docs`` (doc_id, text).

    ``target`` holds the doc_ids of the target corpus (nulls and repeats count for nothing). Losses are nats per
    token over the words, lower-cased A-Z, and the end of the document; null and empty texts have one token.
    Repeated rows are documents of their own; a null doc_id belongs to the background. A lower score is closer to
    the target. Without target documents its model is uniform but for smoothing. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("hit", F.lit(1))
    ids = persist_table(ids, "target")
    few = ids.count() <= broadcast_rows  # its size is checked; beyond that documents are shuffled by id
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = own.join(F.broadcast(ids) if few else ids, "doc_id", "left")
    fold = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)).cast("int")
    own = own.select("doc_id", "text", (fold * 2 + F.coalesce("hit", F.lit(0))).alias("grp"))
    chunks = persist_table(_chunked(own), "chunks")
    each = chunks.select(F.explode(F.arrays_zip("grps", "sizes")).alias("d")).groupBy("d.grps").agg(F.count("*").alias("docs"), F.sum(F.col("d.sizes").cast("long")).alias("tokens"))
    n_docs, tokens = np.zeros(4, np.int64), np.zeros(4, np.int64)
    for grp, d, t in each.collect():  # a row per fold and class
        n_docs[grp], tokens[grp] = d, t
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(tokens.sum()) // PART_KEYS)
    answers = persist_table(_answers(_requests(chunks, parts)), "answers")
    size = answers.where("chunk is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1  # a place for words that nobody has

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for r in left.to_pylist():
            mine = Chunk(r["grps"], r["sizes"], r["words"], r["ids"], parts)
            words, pairs = (mine.answered(k, [tuple(a.values()) for a in right.filter(pa.compute.equal(right.column("kind"), k)).select(["part", "n", "data"]).to_pylist()]) for k in (WORD, PAIR))
            before = np.concatenate([words, n_docs[None]])  # what precedes a first word comes once a document
            other = (1 - (mine.grps >> 1)) * 2
            loss = []
            for target_class in (1, 0):
                column = (other + target_class)[mine.doc]
                p = (words[mine.word, column] + 1) / (tokens[column] + size)
                loss.append(np.bincount(mine.doc, -np.log((pairs[mine.pair, column] + mu * p) / (before[mine.history, column] + mu)), len(mine.sizes)) / mine.sizes)
            for o, v in zip(out, (r["doc_ids"], r["sizes"], loss[0].tolist(), loss[1].tolist()), strict=True):
                o.extend(v)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    asked = answers.where("chunk is not null").select("chunk", "part", "kind", "n", "data")
    done = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return done.withColumn("score", F.col("target_loss") - F.col("background_loss"))
