"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlwrap, packing, simhash, substring, toolcalls, topk, toxicity, warc, xent
from .common import table


def byte_bpe() -> str:
    """Where the public byte-level vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.archive_pages(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = toolcalls.link(table(spark, sf_dir, "conversations"))
    return linked.withColumn("problems", F.array_join("problems", ","))


def op6_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048)


def op9_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = xent.score(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


QUERIES = {f.__name__: f for f in (op1_segment_topk, op2_html_wrapper, op3_warc_zstd, op4_lsa_decontamination, op5_tool_call_linking, op6_ngram_toxicity, op7_simhash_near_dedup, op8_best_fit_packing, op9_fm_substring_dedup, op10_cross_entropy_difference)}
ORACLE_SQL: dict[str, str] = {
    "op1_segment_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.e], [CAST(x AS DOUBLE) FOR x IN c.e]) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM m""",
    # the tables hold plain messages only, so nothing is linked; tests cover tool calls by brute force
    "op5_tool_call_linking": """
        SELECT conv_id, turn, turn AS slot, CAST(0 AS INTEGER) AS level, role, 'message' AS kind,
               '{"content":' || CAST(coalesce(to_json(text), 'null') AS VARCHAR) || ',"role":' || CAST(coalesce(to_json(role), 'null') AS VARCHAR) || '}' AS json,
               CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_linked, '' AS problems
        FROM conversations""",
    "op9_fm_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20)),
        again AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again WHERE n > 1),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op10_cross_entropy_difference": r"""
        WITH d AS (SELECT doc_id, doc_id % 2 AS f, CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS INTEGER) AS c,
                list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        word AS (SELECT doc_id, f, c, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
        tok AS (SELECT doc_id, f, c, i, w FROM word UNION ALL SELECT doc_id, f, c, len(ws), ' end' FROM d),
        pair AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' start') AS h FROM tok),
        big AS (SELECT f, c, h, w, count(*) AS n FROM pair GROUP BY ALL), uni AS (SELECT f, c, w, count(*) AS n FROM pair GROUP BY ALL),
        ctx AS (SELECT f, c, h, count(*) AS n FROM pair GROUP BY ALL), tot AS (SELECT f, c, count(*) AS n FROM pair GROUP BY ALL), size AS (SELECT count(DISTINCT w) + 1 AS v FROM tok),
        class AS (SELECT unnest([0, 1]) AS k),
        loss AS (SELECT p.doc_id, k, count(*) AS n_tokens,
                    avg(-ln((coalesce(big.n, 0) + 50.0 * (coalesce(uni.n, 0) + 1) / (coalesce(tot.n, 0) + v)) / (coalesce(ctx.n, 0) + 50.0))) AS loss
                 FROM pair p CROSS JOIN class CROSS JOIN size
                 LEFT JOIN big ON big.f = 1 - p.f AND big.c = k AND big.h = p.h AND big.w = p.w LEFT JOIN uni ON uni.f = 1 - p.f AND uni.c = k AND uni.w = p.w
                 LEFT JOIN ctx ON ctx.f = 1 - p.f AND ctx.c = k AND ctx.h = p.h LEFT JOIN tot ON tot.f = 1 - p.f AND tot.c = k GROUP BY p.doc_id, k)
        SELECT t.doc_id, t.n_tokens, round(t.loss, 6) AS target_loss, round(b.loss, 6) AS background_loss, round(t.loss - b.loss, 6) AS score
        FROM loss t JOIN loss b ON b.doc_id = t.doc_id AND t.k = 1 AND b.k = 0""",
}
