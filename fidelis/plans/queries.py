"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import gate, relational, suite, timeline
from ..sources import bundle, external, frames, locators, sinks
from . import metrics, video, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _psnr_sql(mse: str) -> str:
    return f"CASE WHEN {mse} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(1.0 / nullif({mse}, 0)) END"


# -- error metrics over rows ------------------------------------------------------------------------------------

_STATS = "count(*) AS samples, avg((ref - dist) * (ref - dist)) AS mse, avg(abs(ref - dist)) AS mae, avg(ref - dist) AS mean_error, max(abs(ref - dist)) AS maxae"


@query(f"""WITH {views.PRICE_SQL}, s AS (SELECT candidate, {_STATS} FROM price GROUP BY candidate)
    SELECT candidate, samples, round(mse, 9) AS mse, round(sqrt(mse), 9) AS rmse, round({_psnr_sql('mse')}, 6) AS psnr, round(mae, 9) AS mae, round(maxae, 9) AS maxae, round(mean_error, 9) AS mean_error FROM s""")
def error_metrics_by_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.error_metrics(views.price_samples(spark, sf_dir), ["candidate"])
    return rounded(out.select("candidate", "samples", "mse", "rmse", "psnr", "mae", "maxae", "mean_error"), mse=9, rmse=9, psnr=6, mae=9, maxae=9, mean_error=9)


@query(f"""WITH {views.PRICE_SQL} SELECT candidate, count(*) AS samples, count(*) FILTER (ref <> dist) AS changed_samples,
    {', '.join(f'count(*) FILTER (abs(ref - dist) * 255.0 > {k}) AS samples_beyond_{k}_lsb' for k in (1, 2, 4, 8))} FROM price GROUP BY candidate""")
def error_lsb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.error_metrics(views.price_samples(spark, sf_dir), ["candidate"])
    return out.select("candidate", "samples", "changed_samples", *(f"samples_beyond_{k}_lsb" for k in (1, 2, 4, 8)))


@query(f"""WITH {views.PRICE_SQL}, b AS (SELECT candidate, CASE WHEN abs(ref - dist) >= 1 THEN 4096 ELSE CAST(round(abs(ref - dist) * 4096) AS INTEGER) END AS bin, count(*) AS n, max(abs(ref - dist)) AS top FROM price GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY candidate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY candidate) AS total, max(top) OVER (PARTITION BY candidate) AS largest FROM b),
    v AS (SELECT *, CASE WHEN bin = 4096 AND largest > 1 THEN largest ELSE bin / 4096.0 END AS v FROM r)
    SELECT candidate, {', '.join(f"round(min(v) FILTER (upto >= greatest(1, ceil(total * {p}))), 9) AS abs_error_{label}" for label, p in (('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))} FROM v GROUP BY candidate""")
def error_histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.error_percentiles(views.price_samples(spark, sf_dir), ["candidate"]), abs_error_p50=9, abs_error_p90=9, abs_error_p95=9, abs_error_p99=9)


@query(f"""WITH {views.PRICE_SQL}, s AS (SELECT candidate, channel, {_STATS} FROM price GROUP BY candidate, channel)
    SELECT candidate, channel, samples, round(mse, 9) AS mse, round({_psnr_sql('mse')}, 6) AS psnr, round(mae, 9) AS mae, round(maxae, 9) AS maxae, round(mean_error * 255.0, 6) AS mean_error_code FROM s""")
def channel_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.error_metrics(views.price_samples(spark, sf_dir), ["candidate", "channel"]).withColumn("mean_error_code", F.col("mean_error") * 255.0)
    return rounded(out.select("candidate", "channel", "samples", "mse", "psnr", "mae", "maxae", "mean_error_code"), mse=9, psnr=6, mae=9, maxae=9, mean_error_code=6)


@query(f"""WITH {views.EMBEDDING_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(ref - dist) DESC, y, x, channel) AS n FROM emb)
    SELECT pair_id, round(abs(ref - dist), 9) AS max_channel_delta, CASE WHEN ref <> dist THEN x END AS max_error_x, CASE WHEN ref <> dist THEN y END AS max_error_y, CASE WHEN ref <> dist THEN channel END AS max_error_channel FROM r WHERE n = 1""")
def max_error_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.max_error_location(views.embedding_frames(spark, sf_dir), ["pair_id"]), max_channel_delta=9)


_LUMA_SQL = "({s}r * 0.2126 + {s}g * 0.7152 + {s}b * 0.0722)"
_RL, _DL = _LUMA_SQL.format(s="r"), _LUMA_SQL.format(s="d")


def _luma(s: str) -> Column:
    return color.luma(*(F.col(f"{s}{c}") for c in "rgb"))


def _channels(px: DataFrame, names: str = "rgb") -> DataFrame:
    """Pixels as samples, a row per channel."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("channel"), F.col(f"r{c}").alias("ref"), F.col(f"d{c}").alias("dist")) for i, c in enumerate(names)))).alias("s")
    return px.select("frame_id", "y", "x", each).select("frame_id", "y", "x", "s.channel", "s.ref", "s.dist")


@query(f"""WITH {views.SYNTH_SQL} SELECT frame_id, count(*) AS pixels, round(avg(({_RL} - {_DL}) * ({_RL} - {_DL})), 9) AS mse_luma,
    round(avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3), 9) AS mse_color,
    round(avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db) + (ra - da) * (ra - da)) / 4), 9) AS mse_all FROM px GROUP BY frame_id""")
def shared_scan_multi_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.synthetic_pixels(spark, sf_dir)
    sq = lambda a, b: (a - b) * (a - b)
    parts = {c: sq(F.col(f"r{c}"), F.col(f"d{c}")) for c in "rgba"}
    rgb = parts["r"] + parts["g"] + parts["b"]
    out = px.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.avg(sq(_luma("r"), _luma("d"))).alias("mse_luma"), F.avg(rgb / 3).alias("mse_color"), F.avg((rgb + parts["a"]) / 4).alias("mse_all"))
    return rounded(out, mse_luma=9, mse_color=9, mse_all=9)


_PIXELS_SQL = f"""{views.SYNTH_SQL}, top AS (SELECT frame_id, greatest(abs(rr - dr), abs(rg - dg), abs(rb - db)) AS top, sqrt((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) AS norm FROM px)"""


@query(f"""WITH {_PIXELS_SQL} SELECT frame_id, count(*) AS pixel_count, count(*) FILTER (top <> 0) AS changed_pixels,
    {', '.join(f'count(*) FILTER (top * 255.0 > {k}) AS pixels_beyond_{k}_lsb' for k in (1, 2, 4, 8))}, round(max(norm), 9) AS max_pixel_delta FROM top GROUP BY frame_id""")
def pixel_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.pixel_statistics(_channels(views.synthetic_pixels(spark, sf_dir)), ["frame_id"]), max_pixel_delta=9)


# -- SSIM over rows ---------------------------------------------------------------------------------------------

_SSIM = "(2 * mx * my + 0.0001) / (mx * mx + my * my + 0.0001) * cs"


@query(f"""WITH {views.EMBEDDING_SQL}, m AS (SELECT pair_id, count(*) AS samples, avg(ref) AS mx, avg(dist) AS my, var_samp(ref) AS vx, var_samp(dist) AS vy, covar_samp(ref, dist) AS c FROM emb GROUP BY pair_id),
    s AS (SELECT *, (2 * c + 0.0009) / (vx + vy + 0.0009) AS cs FROM m)
    SELECT pair_id, samples, round({_SSIM}, 8) AS ssim, round(cs, 8) AS contrast_structure FROM s""")
def global_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.global_ssim(views.embedding_frames(spark, sf_dir), ["pair_id"])
    return rounded(out.select("pair_id", "samples", "ssim", "contrast_structure"), ssim=8, contrast_structure=8)


def _windows_sql(source: str, key: str, n: int, w: int, starts: str) -> str:
    k = float(w * w)
    return f"""win AS (SELECT {key}, y0, x0, sum(ref) AS sx, sum(dist) AS sy, sum(ref * ref) AS sxx, sum(dist * dist) AS syy, sum(ref * dist) AS sxy
        FROM {source}, (SELECT unnest({starts}) AS y0), (SELECT unnest({starts}) AS x0) WHERE y >= y0 AND y < y0 + {w} AND x >= x0 AND x < x0 + {w} GROUP BY ALL),
    wm AS (SELECT {key}, y0, x0, sx / {k} AS mx, sy / {k} AS my, greatest(sxx - sx * sx / {k}, 0) / {k - 1} AS vx, greatest(syy - sy * sy / {k}, 0) / {k - 1} AS vy, (sxy - sx * sy / {k}) / {k - 1} AS c FROM win),
    wc AS (SELECT *, (2 * c + 0.0009) / (vx + vy + 0.0009) AS cs FROM wm), ws AS (SELECT {key}, y0, x0, cs, {_SSIM} AS ssim FROM wc)"""


@query(f"""WITH {views.EMBEDDING_SQL}, {_windows_sql('emb', 'pair_id', 8, 4, '[0, 3, 4]')},
    b AS (SELECT *, CAST(round((greatest(-1, least(1, ssim)) + 1) * 0.5 * 4096) AS INTEGER) AS bin FROM ws),
    u AS (SELECT *, count(*) OVER (PARTITION BY pair_id ORDER BY bin) AS upto, count(*) OVER (PARTITION BY pair_id) AS total, row_number() OVER (PARTITION BY pair_id ORDER BY round(ssim, 12), y0, x0) AS n FROM b)
    SELECT pair_id, count(*) AS windows, round(avg(ssim), 8) AS wssim, round(min(ssim), 8) AS min_window_ssim, round(max(ssim), 8) AS max_window_ssim, max(x0) FILTER (n = 1) AS worst_window_x, max(y0) FILTER (n = 1) AS worst_window_y,
           min(bin) FILTER (upto >= greatest(1, ceil(total * 0.5))) / 4096.0 * 2 - 1 AS p50_window_ssim FROM u GROUP BY pair_id""")
def windowed_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.windowed_ssim(views.embedding_frames(spark, sf_dir), ["pair_id"], 8, 8, (4, 4), (3, 3))
    return rounded(out.select("pair_id", "windows", "wssim", "min_window_ssim", "max_window_ssim", "worst_window_x", "worst_window_y", "p50_window_ssim"), wssim=8, min_window_ssim=8, max_window_ssim=8)


@query(f"""WITH {views.EMBEDDING_SQL}, h AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, avg(ref) AS ref, avg(dist) AS dist FROM emb GROUP BY ALL), q AS (SELECT pair_id, y // 2 AS y, x // 2 AS x, avg(ref) AS ref, avg(dist) AS dist FROM h GROUP BY ALL),
    m AS (SELECT pair_id, count(*) AS samples, avg(ref) AS mx, avg(dist) AS my, var_samp(ref) AS vx, var_samp(dist) AS vy, covar_samp(ref, dist) AS c FROM q GROUP BY pair_id),
    s AS (SELECT *, (2 * c + 0.0009) / (vx + vy + 0.0009) AS cs FROM m) SELECT pair_id, samples, round({_SSIM}, 8) AS ssim FROM s""")
def ms_ssim_level_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = relational.halve(relational.halve(views.embedding_frames(spark, sf_dir), ["pair_id"]), ["pair_id"])
    return rounded(relational.global_ssim(twice, ["pair_id"]).select("pair_id", "samples", "ssim"), ssim=8)


# -- suites and gates -------------------------------------------------------------------------------------------


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of all suppliers in suites by nation; scores are cut to 9 digits, so that ties are ties everywhere."""
    wide = relational.error_metrics(views.price_samples(spark, sf_dir), ["candidate"])
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.round(n, 9).alias("score"), F.lit(d).alias("direction")) for i, (n, d) in enumerate((("psnr", "higher"), ("mse", "lower"), ("mae", "lower"))))))
    supplier = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate"), F.col("s_nationkey").alias("suite_id"))
    details = F.create_map(F.lit("samples"), F.col("samples").cast("double"), F.lit("maxae"), F.round("maxae", 9))
    rows = wide.join(supplier, "candidate").select("suite_id", F.lpad(F.col("candidate").cast("string"), 9, "0").alias("label"), F.col("candidate").alias("ord"), details.alias("details"), named.alias("m"))
    return rows.select("suite_id", "label", "ord", "m.*", "details")


_SUITE_SQL = f"""{views.PRICE_SQL}, st AS (SELECT candidate, {_STATS} FROM price GROUP BY candidate),
    wide AS (SELECT s_nationkey AS suite_id, lpad(CAST(candidate AS VARCHAR), 9, '0') AS label, candidate AS ord, samples, round(maxae, 9) AS maxae, round({_psnr_sql('mse')}, 9) AS psnr, round(mse, 9) AS mse, round(mae, 9) AS mae FROM st JOIN supplier ON s_suppkey = candidate),
    rows_ AS (SELECT suite_id, label, ord, 'psnr' AS name, psnr AS score, 'higher' AS direction FROM wide UNION ALL SELECT suite_id, label, ord, 'mse', mse, 'lower' FROM wide UNION ALL SELECT suite_id, label, ord, 'mae', mae, 'lower' FROM wide),
    k AS (SELECT *, CASE WHEN direction = 'lower' THEN score ELSE -score END AS key FROM rows_),
    pl AS (SELECT *, row_number() OVER w AS n, lag(key) OVER w AS p FROM k WINDOW w AS (PARTITION BY suite_id, name ORDER BY key, label)),
    rk AS (SELECT *, max(CASE WHEN p IS NULL OR NOT (abs(p - key) <= 1e-12 + 1e-9 * greatest(abs(p), abs(key))) THEN n END) OVER (PARTITION BY suite_id, name ORDER BY key, label ROWS UNBOUNDED PRECEDING) AS rank FROM pl)"""


@query(f"WITH {_SUITE_SQL} SELECT suite_id, label, name, score, CAST(rank AS INTEGER) AS rank FROM rk")
def suite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.metric_ranks(supplier_rows(spark, sf_dir), ["suite_id"]).select("suite_id", "label", "name", "score", "rank")


_OVERALL_SQL = f"""{_SUITE_SQL}, mr AS (SELECT suite_id, label, min(ord) AS ord, sum(rank * CASE name WHEN 'psnr' THEN 2.0 WHEN 'mae' THEN 0.5 ELSE 1.0 END) / sum(CASE name WHEN 'psnr' THEN 2.0 WHEN 'mae' THEN 0.5 ELSE 1.0 END) AS mean_rank FROM rk GROUP BY ALL),
    op AS (SELECT *, row_number() OVER w AS n, lag(mean_rank) OVER w AS p FROM mr WINDOW w AS (PARTITION BY suite_id ORDER BY mean_rank, label)),
    ov AS (SELECT *, max(CASE WHEN p IS NULL OR NOT (abs(p - mean_rank) <= 1e-12 + 1e-9 * greatest(abs(p), abs(mean_rank))) THEN n END) OVER (PARTITION BY suite_id ORDER BY mean_rank, label ROWS UNBOUNDED PRECEDING) AS overall_rank FROM op)"""


@query(f"WITH {_OVERALL_SQL} SELECT suite_id, label, round(mean_rank, 9) AS mean_rank, CAST(overall_rank AS INTEGER) AS overall_rank FROM ov")
def suite_mean_rank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = suite.metric_ranks(supplier_rows(spark, sf_dir), ["suite_id"])
    out = suite.overall_ranks(ranked, ["suite_id"], {"psnr": 2.0, "mae": 0.5})
    return rounded(out.select("suite_id", "label", "mean_rank", "overall_rank"), mean_rank=9)


@query(f"WITH {_OVERALL_SQL} SELECT suite_id, arg_min(label, ord) AS winner FROM ov WHERE overall_rank = 1 GROUP BY suite_id")
def suite_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = suite.metric_ranks(supplier_rows(spark, sf_dir), ["suite_id"])
    return suite.winners(suite.overall_ranks(ranked, ["suite_id"], {"psnr": 2.0, "mae": 0.5}), ["suite_id"])


_EQ = "(abs({a} - {b}) <= 1e-12 + 1e-9 * greatest(abs({a}), abs({b})))"


@query(f"""WITH {_SUITE_SQL}, pf AS (SELECT suite_id, label, psnr, -mse AS mse, -mae AS mae FROM wide)
    SELECT a.suite_id, a.label, NOT EXISTS (SELECT 1 FROM pf b WHERE b.suite_id = a.suite_id AND b.label <> a.label
        AND {' AND '.join(f'({_EQ.format(a=f"a.{m}", b=f"b.{m}")} OR b.{m} > a.{m})' for m in ('psnr', 'mse', 'mae'))}
        AND ({' OR '.join(f'(NOT {_EQ.format(a=f"a.{m}", b=f"b.{m}")} AND b.{m} > a.{m})' for m in ('psnr', 'mse', 'mae'))})) AS pareto_optimal FROM pf a""")
def suite_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.pareto_frontier(supplier_rows(spark, sf_dir), ["suite_id"])


@query(f"""WITH {_SUITE_SQL}, base AS (SELECT suite_id, name, arg_min(score, label) AS baseline_score FROM rows_ GROUP BY ALL)
    SELECT suite_id, label, name, round(score - baseline_score, 9) AS delta FROM rows_ JOIN base USING (suite_id, name)""")
def suite_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir)
    first = rows.groupBy("suite_id").agg(F.min("label").alias("first"))
    marked = rows.join(first, "suite_id")
    return rounded(suite.baseline_deltas(marked, ["suite_id"], F.col("first")).select("suite_id", "label", "name", "delta"), delta=9)


@query(f"""WITH {_SUITE_SQL} SELECT suite_id, label, psnr >= 25 AND mse <= 0.002 AND maxae < 0.1 AND FALSE AS passed,
    CAST((NOT psnr >= 25)::INT + (NOT mse <= 0.002)::INT + (NOT maxae < 0.1)::INT + 2 AS BIGINT) AS failures FROM wide""")
def gate_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = gate.evaluate(supplier_rows(spark, sf_dir), ["suite_id", "label"], ["psnr>=25", "mse<=0.002", "mse.maxae<0.1", "ssim>0.9", "psnr.unknown>0"])
    return gate.verdicts(checks, ["suite_id", "label"])


@query(f"""WITH {_SUITE_SQL}, b AS (SELECT psnr AS bp, mse AS bm, maxae AS bx FROM (SELECT st.candidate, round({_psnr_sql('mse')}, 9) AS psnr, round(mse, 9) AS mse, round(maxae, 9) AS maxae FROM st WHERE candidate = 1)),
    c AS (SELECT label, 0 AS rule_index, psnr AS score, bp - 0.5 AS threshold, psnr >= bp - 0.5 AS passed FROM wide, b UNION ALL SELECT label, 1, mse, bm * 1.1, mse <= bm * 1.1 FROM wide, b UNION ALL SELECT label, 2, maxae, bx / 2, maxae < bx / 2 FROM wide, b)
    SELECT label, CAST(rule_index AS INTEGER) AS rule_index, score, round(threshold, 9) AS threshold, passed FROM c""")
def gate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).drop("suite_id")
    checks = gate.evaluate(rows, ["label"], ["psnr>=baseline-0.5", "mse<=baseline*1.1", "mae.maxae<baseline/2"], baseline="000000001")
    return rounded(checks.select("label", "rule_index", "score", "threshold", "passed"), threshold=9)


@query(f"""WITH {_OVERALL_SQL}, rr AS (SELECT suite_id, label, name, rank FROM rk)
    SELECT CAST(suite_id AS VARCHAR) AS reference, r.label AS candidate, CAST(overall_rank AS INTEGER) AS overall_rank, r.name AS metric, r.score, CAST(r.rank AS INTEGER) AS metric_rank FROM rk r JOIN ov USING (suite_id, label)""")
def suite_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = suite.metric_ranks(supplier_rows(spark, sf_dir), ["suite_id"]).withColumn("unit", F.lit("unit"))
    overall = suite.overall_ranks(ranked, ["suite_id"], {"psnr": 2.0, "mae": 0.5}).withColumn("reference", F.col("suite_id").cast("string"))
    out = sinks.suite_csv_rows(overall, ranked, ["suite_id"])
    return out.select("reference", "candidate", "overall_rank", "metric", "score", "metric_rank")


# -- timelines --------------------------------------------------------------------------------------------------

_NEAREST_SQL = f"""{views.TIMELINE_SQL}, lo AS (SELECT r.idx AS ri, r.pts AS rp, d.idx AS di, d.pts AS dp FROM tr r ASOF JOIN td d ON r.pts > d.pts), hi AS (SELECT r.idx AS ri, r.pts AS rp, d.idx AS di, d.pts AS dp FROM tr r ASOF JOIN td d ON r.pts <= d.pts),
    near AS (SELECT *, row_number() OVER (PARTITION BY ri ORDER BY abs(rp - dp), di) AS n FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi)), pairs AS (SELECT ri, di, rp, dp FROM near WHERE n = 1 AND abs(rp - dp) <= 600)"""


@query(f"WITH {_NEAREST_SQL} SELECT ri AS reference_index, di AS distorted_index, round(abs(rp - dp), 6) AS delta_seconds FROM pairs")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = views.timelines(spark, sf_dir)
    return rounded(timeline.nearest_with_reuse(r, d, [], 600.0).select("reference_index", "distorted_index", "delta_seconds"), delta_seconds=6)


@query(f"""WITH {_NEAREST_SQL} SELECT 'reference' AS side, idx AS "index" FROM tr WHERE idx NOT IN (SELECT ri FROM pairs) UNION ALL SELECT 'distorted', idx FROM td WHERE idx NOT IN (SELECT di FROM pairs)""")
def asof_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = views.timelines(spark, sf_dir)
    pairs = timeline.nearest_with_reuse(r, d, [], 600.0)
    left = lambda df, side: timeline.unmatched(df, pairs, [], side).select(F.lit(side).alias("side"), "index")
    return left(r, "reference").union(left(d, "distorted"))


_FIT_SQL = f"""{views.TIMELINE_SQL}, k AS (SELECT least((SELECT count(*) FROM tr), (SELECT count(*) FROM td), 129) AS k), q AS (SELECT unnest(range(k)) / (k - 1) AS q FROM k),
    pt AS (SELECT q, (SELECT list_sort(list(pts)) FROM tr) AS r, (SELECT list_sort(list(pts)) FROM td) AS d FROM q),
    at_ AS (SELECT q * (len(r) - 1) AS pr, q * (len(d) - 1) AS pd, r, d FROM pt),
    xy AS (SELECT d[CAST(floor(pd) AS INT) + 1] * (1 - (pd - floor(pd))) + d[CAST(ceil(pd) AS INT) + 1] * (pd - floor(pd)) AS x, r[CAST(floor(pr) AS INT) + 1] * (1 - (pr - floor(pr))) + r[CAST(ceil(pr) AS INT) + 1] * (pr - floor(pr)) AS y FROM at_),
    fit AS (SELECT covar_pop(y, x) / var_pop(x) AS scale, avg(x) AS mx, avg(y) AS my FROM xy)"""


@query(f"WITH {_FIT_SQL} SELECT round(scale, 6) AS scale, round(my - scale * mx, 2) AS shift FROM fit")
def align_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = views.timelines(spark, sf_dir)
    return timeline.estimate_transform(r, d, []).select(F.round("scale", 6).alias("scale"), F.round("offset", 2).alias("shift"))


@query(f"WITH {_NEAREST_SQL} SELECT count(*) AS pairs, round(avg(rp - dp), 6) AS mean_signed_delta, round(avg(abs(rp - dp)), 6) AS mean_absolute_delta, round(sqrt(avg((rp - dp) * (rp - dp))), 6) AS rms_delta, round(max(abs(rp - dp)), 6) AS max_delta FROM pairs")
def align_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = views.timelines(spark, sf_dir)
    out = timeline.residuals(timeline.nearest_with_reuse(r, d, [], 600.0), [])
    return rounded(out, mean_signed_delta=6, mean_absolute_delta=6, rms_delta=6, max_delta=6)


@query()
def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = views.timelines(spark, sf_dir)
    return rounded(timeline.nearest_once(r, d, [], 600.0).select("reference_index", "distorted_index", "delta_seconds"), delta_seconds=6)


def _decoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    from pyspark.sql import Window

    return e.select((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame_index"), "user_id", F.col("value").alias(kind))


_LOCK_SQL = "v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, value FROM events WHERE event_type = 'view'), c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, value FROM events WHERE event_type = 'click')"


@query(f"WITH {_LOCK_SQL} SELECT v.user_id, CAST(v.f AS BIGINT) AS frame_index, round(v.value - c.value, 6) AS delta FROM v JOIN c ON v.user_id = c.user_id AND v.f = c.f WHERE v.f % 2 = 0")
def lockstep_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.lockstep(_decoded(spark, sf_dir, "view"), _decoded(spark, sf_dir, "click"), ["user_id"], every=2)
    return out.select("user_id", F.col("frame_index").cast("long").alias("frame_index"), F.round(F.col("view") - F.col("click"), 6).alias("delta"))


@query(f"""WITH {_LOCK_SQL}, a AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM c GROUP BY 1), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS r, coalesce(b.n, 0) AS d FROM a FULL JOIN b ON a.user_id = b.user_id)
    SELECT user_id, r AS reference_frames, d AS distorted_frames, least(r, d) AS compared_frames, r <= d AS reference_ended, d <= r AS distorted_ended, r <> d AS length_mismatch FROM j""")
def lockstep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lockstep_summary(_decoded(spark, sf_dir, "view"), _decoded(spark, sf_dir, "click"), ["user_id"])


_TWM_SQL = """p AS (SELECT name, pts, avg(score) AS s FROM fin GROUP BY name, pts), l AS (SELECT *, lead(pts) OVER (PARTITION BY name ORDER BY pts) - pts AS d FROM p),
    md AS (SELECT name, quantile_cont(d, 0.5) AS med FROM l GROUP BY name), tw AS (SELECT name, sum(s * coalesce(d, med)) / sum(coalesce(d, med)) AS twm FROM l JOIN md USING (name) GROUP BY name)"""


@query(f"""WITH {views.SERIES_SQL}, {_TWM_SQL}, c AS (SELECT name, count(*) AS total_samples, count(*) FILTER (isnan(score)) AS nan_samples, count(*) FILTER (isinf(score) AND score > 0) AS positive_infinite_samples FROM series GROUP BY name)
    SELECT name, count(*) AS samples, any_value(total_samples) AS total_samples, any_value(nan_samples) AS nan_samples, any_value(positive_infinite_samples) AS positive_infinite_samples, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max,
        round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS standard_deviation, round(quantile_cont(score, 0.01), 6) AS p1, round(quantile_cont(score, 0.95), 6) AS p95, round(any_value(twm), 6) AS time_weighted_mean FROM fin JOIN c USING (name) JOIN tw USING (name) GROUP BY name""")
def series_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.series_aggregate(views.metric_series(spark, sf_dir), ["name"])
    doubles = ("mean", "min", "max", "median", "standard_deviation", "p1", "p95", "time_weighted_mean")
    return rounded(out.select("name", "samples", "total_samples", "nan_samples", "positive_infinite_samples", *doubles), **dict.fromkeys(doubles, 6))


@query(f"WITH {views.SERIES_SQL}, {_TWM_SQL} SELECT name, round(twm, 6) AS time_weighted_mean FROM tw")
def time_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeline.time_weighted_mean(views.metric_series(spark, sf_dir), ["name"]), time_weighted_mean=6)


@query(f"""WITH {views.SERIES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE direction WHEN 'higher' THEN score WHEN 'lower' THEN -score ELSE -abs(score) END, frame_index) AS n FROM fin)
    SELECT name, frame_index AS worst_frame_index, round(score, 6) AS worst_score FROM b WHERE n = 1""")
def worst_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.series_aggregate(views.metric_series(spark, sf_dir), ["name"])
    return rounded(out.select("name", "worst_frame_index", "worst_score"), worst_score=6)


@query(f"WITH {views.SERIES_SQL}, n AS (SELECT name, count(*) AS frames FROM series GROUP BY name) SELECT 'mean_' || name AS name, round(avg(score), 6) AS score, CAST(any_value(frames) AS DOUBLE) AS frames FROM fin JOIN n USING (name) GROUP BY name")
def video_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.metric_means(views.metric_series(spark, sf_dir), [])
    return out.select("name", F.round("score", 6).alias("score"), F.col("details")["frames"].alias("frames"))


# -- pixels -----------------------------------------------------------------------------------------------------


@query(f"""WITH {views.SYNTH_SQL}, c AS (SELECT frame_id, CAST(round(ra * 255) AS INTEGER) AS a, CAST(round(da * 255) AS INTEGER) AS b FROM px) SELECT frame_id,
    {', '.join(f"count(*) FILTER ({c} = 0) AS {s}_transparent, count(*) FILTER ({c} = 255) AS {s}_opaque, count(*) FILTER ({c} > 0 AND {c} < 255) AS {s}_partial" for s, c in (('reference', 'a'), ('distorted', 'b')))},
    count(*) FILTER (a <> b) AS mismatch_count, max(abs(a - b)) AS max_delta, count(*) FILTER (abs(a - b) > 1) AS mismatches_beyond_one_lsb FROM c GROUP BY frame_id""")
def alpha_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.alpha_statistics(views.synthetic_pixels(spark, sf_dir), ["frame_id"])


_MASKED = "round(avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3), 9) AS mse"


def _masked(px: DataFrame) -> DataFrame:
    sq = lambda c: (F.col(f"r{c}") - F.col(f"d{c}")) * (F.col(f"r{c}") - F.col(f"d{c}"))
    return px.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.round(F.avg((sq("r") + sq("g") + sq("b")) / 3), 9).alias("mse"))


def _mask_query(mask: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _masked(views.synthetic_pixels(spark, sf_dir).where(relational.mask_column(mask)))

    run.__name__ = f"mask_{mask}"
    query(f"WITH {views.SYNTH_SQL} SELECT frame_id, count(*) AS pixels, {_MASKED} FROM px WHERE {condition} GROUP BY frame_id")(run)


_mask_query("visible", "ra > 0 OR da > 0")
_mask_query("opaque", "ra >= 1 AND da >= 1")
_mask_query("nonblack", "greatest(rr, rg, rb, dr, dg, db) > 0")


@query(f"""WITH {views.SYNTH_SQL}, i AS (SELECT frame_id, y, x FROM px WHERE ra > 0 AND da > 0), keep AS (SELECT a.frame_id, a.y, a.x FROM i a JOIN i b ON a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9)
    SELECT frame_id, count(*) AS pixels, {_MASKED} FROM px SEMI JOIN keep USING (frame_id, y, x) GROUP BY frame_id""")
def mask_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.synthetic_pixels(spark, sf_dir)
    return _masked(relational.interior(px, ["frame_id"], relational.mask_column("visible", inner=True), 1))


@query(f"WITH {views.SYNTH_SQL} SELECT frame_id, round(avg({_RL}), 9) AS luma709, round(avg(rr * 0.299 + rg * 0.587 + rb * 0.114), 9) AS luma601, round(avg(rr * 0.2627 + rg * 0.6780 + rb * 0.0593), 9) AS luma2020 FROM px GROUP BY frame_id")
def luma_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [F.col(f"r{c}") for c in "rgb"]
    px = views.synthetic_pixels(spark, sf_dir)
    return px.groupBy("frame_id").agg(*(F.round(F.avg(color.luma(*rgb, space=s)), 9).alias(n) for s, n in (("bt709", "luma709"), ("bt601", "luma601"), ("bt2020", "luma2020"))))


def _hsv_sql(s: str) -> str:
    r, g, b = (f"{s}{c}" for c in "rgb")
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d = f"({top} - {low})"
    six = lambda e: f"(({e}) - floor(({e}) / 6) * 6)"
    hue = f"CASE WHEN {d} = 0 THEN 0 WHEN {top} = {r} THEN {six(f'({g} - {b}) / nullif({d}, 0)')} / 6 WHEN {top} = {g} THEN (({b} - {r}) / nullif({d}, 0) + 2) / 6 ELSE (({r} - {g}) / nullif({d}, 0) + 4) / 6 END"
    return f"{hue} AS {s}h, CASE WHEN {top} = 0 THEN 0 ELSE {d} / nullif({top}, 0) END AS {s}s, {top} AS {s}v"


@query(f"""WITH {views.SYNTH_SQL}, h AS (SELECT frame_id, {_hsv_sql('r')}, {_hsv_sql('d')} FROM px), w AS (SELECT *, CASE WHEN abs(rh - dh) <= 0.5 THEN rh - dh WHEN rh > dh THEN rh - dh - 1 ELSE rh - dh + 1 END AS hd FROM h)
    SELECT frame_id, round(avg(rh), 8) AS hue, round(avg(rs), 8) AS saturation, round(avg(rv), 8) AS value, round(avg((hd * hd + (rs - ds) * (rs - ds) + (rv - dv) * (rv - dv)) / 3), 8) AS mse_hsv FROM w GROUP BY frame_id""")
def hsv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.synthetic_pixels(spark, sf_dir)
    (rh, rs, rv), (dh, ds, dv) = (color.rgb_to_hsv(*(F.col(f"{s}{c}") for c in "rgb")) for s in "rd")
    h = px.select("frame_id", rh.alias("rh"), rs.alias("rs"), rv.alias("rv"), dh.alias("dh"), ds.alias("ds"), dv.alias("dv"))
    hd = relational.wrap_hue(F.col("rh") - F.col("dh"))
    sq = lambda c: c * c
    mse = (sq(hd) + sq(F.col("rs") - F.col("ds")) + sq(F.col("rv") - F.col("dv"))) / 3
    return h.groupBy("frame_id").agg(F.round(F.avg("rh"), 8).alias("hue"), F.round(F.avg("rs"), 8).alias("saturation"), F.round(F.avg("rv"), 8).alias("value"), F.round(F.avg(mse), 8).alias("mse_hsv"))


@query(f"""WITH {views.SYNTH_SQL}, y AS (SELECT frame_id, rr AS y, rg - 0.5 AS u, rb - 0.5 AS v, greatest(0, least(1, (rr * 255 - 16) / 219)) AS ly, greatest(0, least(1, (rb * 255 - 16) / 224)) - 0.5 AS lv FROM px)
    SELECT frame_id, round(avg(greatest(0, least(1, y + v * 1.5748))), 8) AS red709, round(avg(greatest(0, least(1, y - u * 0.344136 - v * 0.714136))), 8) AS green601, round(avg(greatest(0, least(1, y + u * 1.8814))), 8) AS blue2020, round(avg(greatest(0, least(1, ly + lv * 1.5748))), 8) AS red_limited FROM y GROUP BY frame_id""")
def yuv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, u, v = (F.col(f"r{c}") for c in "rgb")
    r7, _, _ = color.yuv_to_rgb(y, u, v, "bt709")
    _, g6, _ = color.yuv_to_rgb(y, u, v, "bt601")
    _, _, b2 = color.yuv_to_rgb(y, u, v, "bt2020")
    rl, _, _ = color.yuv_to_rgb(y, u, v, "bt709", "limited")
    named = {"red709": r7, "green601": g6, "blue2020": b2, "red_limited": rl}
    return views.synthetic_pixels(spark, sf_dir).groupBy("frame_id").agg(*(F.round(F.avg(c), 8).alias(n) for n, c in named.items()))


_PQ_P = "pow(v, 1.0 / 78.84375)"


@query(f"""WITH g AS (SELECT i, i / 255.0 AS v FROM range(256) t(i)) SELECT i AS code, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END, 9) AS srgb, round(pow(v, 2.4), 9) AS bt1886,
    round(CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp(v - 0.55991073) + 0.28466892) / 12 / exp(0.17883277) END, 9) AS hlg, round(pow(greatest({_PQ_P} - 0.8359375, 0) / (18.8515625 - 18.6875 * {_PQ_P}), 1.0 / 0.1593017578125), 9) AS pq,
    round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE pow(v, 1.0 / 2.4) * 1.055 - 0.055 END, 9) AS srgb_encoded FROM g""")
def transfer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("id") / 255.0
    curves = {k: color.decode_transfer(v, k) for k in ("srgb", "bt1886", "hlg", "pq")} | {"srgb_encoded": color.encode_transfer(v, "srgb")}
    return spark.range(256).select(F.col("id").alias("code"), *(F.round(c, 9).alias(n) for n, c in curves.items()))


def _values(px: DataFrame) -> DataFrame:
    luma = F.round(_luma("r"), 12)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), c.alias("v")) for n, c in (("red", F.col("rr")), ("green", F.col("rg")), ("blue", F.col("rb")), ("alpha", F.col("ra")), ("luma", luma))))).alias("s")
    return px.select("frame_id", each).select("frame_id", "s.channel", "s.v")


_VALUES_SQL = f"{views.SYNTH_SQL}, vals AS (SELECT frame_id, 'red' AS channel, rr AS v FROM px UNION ALL SELECT frame_id, 'green', rg FROM px UNION ALL SELECT frame_id, 'blue', rb FROM px UNION ALL SELECT frame_id, 'alpha', ra FROM px UNION ALL SELECT frame_id, 'luma', round({_RL}, 12) FROM px)"


@query(f"""WITH {_VALUES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, channel ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id, channel) AS n FROM vals),
    hb AS (SELECT frame_id, channel, least(floor(v * 256), 255) AS b, count(*) AS c FROM vals GROUP BY ALL), ht AS (SELECT frame_id, channel, sum(c) AS t FROM hb GROUP BY ALL), en AS (SELECT frame_id, channel, sum(-c / t * log2(c / t)) AS e FROM hb JOIN ht USING (frame_id, channel) GROUP BY ALL)
    SELECT frame_id, channel, count(*) AS pixels, round(min(v), 9) AS min, round(max(v), 9) AS max, round(avg(v), 9) AS mean, round(stddev_pop(v), 6) AS std_dev, {', '.join(f'round(max(v) FILTER (i = round((n - 1) * {p})), 9) AS {k}' for k, p in (('median', 0.5), ('p01', 0.01), ('p95', 0.95)))},
        round(any_value(e), 6) AS entropy_bits, round(avg((v <= 1 / 255.0)::INT), 9) AS clipped_low_ratio, round(avg((v >= 254 / 255.0)::INT), 9) AS clipped_high_ratio FROM o JOIN en USING (frame_id, channel) GROUP BY frame_id, channel""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.channel_profile(_values(views.synthetic_pixels(spark, sf_dir)), ["frame_id", "channel"])
    nine = ("min", "max", "mean", "median", "p01", "p95", "clipped_low_ratio", "clipped_high_ratio")
    return rounded(out.select("frame_id", "channel", "pixels", "min", "max", "mean", "std_dev", "median", "p01", "p95", "entropy_bits", "clipped_low_ratio", "clipped_high_ratio"), **dict.fromkeys(nine, 9), std_dev=6, entropy_bits=6)


@query(f"""WITH {_VALUES_SQL}, b AS (SELECT frame_id, channel, CAST(least(floor(v * 16), 15) AS INTEGER) AS bin, count(*) AS n FROM vals GROUP BY ALL), g AS (SELECT DISTINCT frame_id, channel FROM vals)
    SELECT g.frame_id, g.channel, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS "count" FROM g CROSS JOIN range(16) t(i) LEFT JOIN b ON b.frame_id = g.frame_id AND b.channel = g.channel AND b.bin = i""")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.value_histogram(_values(views.synthetic_pixels(spark, sf_dir)), ["frame_id", "channel"], 16)


_S = views.SIDE
_CENTER = f"(x >= {_S // 4} AND x < {_S * 3 // 4} AND y >= {_S // 4} AND y < {_S * 3 // 4})"


@query(f"""WITH {views.SYNTH_SQL}, l AS (SELECT frame_id, y, x, {_RL} AS luma FROM px) SELECT frame_id, round(avg(luma) FILTER ({_CENTER}), 9) AS center_luma_mean, round(avg(luma) FILTER (NOT {_CENTER}), 9) AS border_luma_mean,
    round(avg(luma) FILTER (y < {_S // 2}), 9) AS top_luma_mean, round(avg(luma) FILTER (x >= {_S // 2}), 9) AS right_luma_mean, round(avg(luma) FILTER ({_CENTER}) - avg(luma) FILTER (NOT {_CENTER}), 9) AS center_border_delta FROM l GROUP BY frame_id""")
def spatial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.synthetic_pixels(spark, sf_dir).withColumn("luma", _luma("r"))
    names = ("center_luma_mean", "border_luma_mean", "top_luma_mean", "right_luma_mean", "center_border_delta")
    return rounded(relational.spatial_means(px, ["frame_id"], _S, _S).select("frame_id", *names), **dict.fromkeys(names, 9))


_BALANCE_SQL = f"{views.SYNTH_SQL}, m AS (SELECT frame_id, avg(rr) AS r, avg(rg) AS g, avg(rb) AS b FROM px GROUP BY frame_id)"


@query(f"""WITH {_BALANCE_SQL} SELECT frame_id, round(r / (r + g + b), 9) AS normalized_red, round(r - b, 9) AS red_minus_blue, round(g - (r + b) * 0.5, 9) AS green_magenta, round(r - b + 0.25 * (g - b), 9) AS warm_cool_score, round((r + g + b) / 3 / greatest(b, 1 / 255.0), 9) AS gain_blue,
    CASE WHEN round(b, 12) >= round(r, 12) AND round(b, 12) >= round(g, 12) THEN 'blue' WHEN round(g, 12) >= round(r, 12) THEN 'green' ELSE 'red' END AS dominant_channel FROM m""")
def color_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.synthetic_pixels(spark, sf_dir).groupBy("frame_id").agg(*(F.round(F.avg(f"r{c}"), 12).alias(c) for c in "rgb"))
    b = relational.color_balance(F.col("r"), F.col("g"), F.col("b"))
    names = ("normalized_red", "red_minus_blue", "green_magenta", "warm_cool_score", "gain_blue")
    return rounded(means.select("frame_id", *(b[n].alias(n) for n in names), b["dominant_channel"].alias("dominant_channel")), **dict.fromkeys(names, 9))


@query(f"""WITH {_BALANCE_SQL}, sv AS (SELECT frame_id, avg({_RL}) AS lm, stddev_pop({_RL}) AS ls, avg(CASE WHEN greatest(rr, rg, rb) = 0 THEN 0 ELSE (greatest(rr, rg, rb) - least(rr, rg, rb)) / greatest(rr, rg, rb) END) AS sm, min(ra) AS am, avg(ra) AS aa FROM px GROUP BY frame_id)
    SELECT frame_id, CASE WHEN lm < 0.25 THEN 'dark' WHEN lm > 0.75 THEN 'bright' ELSE 'balanced' END AS exposure, CASE WHEN ls < 0.08 THEN 'low' WHEN ls > 0.24 THEN 'high' ELSE 'medium' END AS contrast, CASE WHEN sm < 0.1 THEN 'muted' WHEN sm > 0.55 THEN 'vivid' ELSE 'moderate' END AS saturation,
        CASE WHEN r - b > 0.05 THEN 'warm' WHEN r - b < -0.05 THEN 'cool' ELSE 'neutral' END AS temperature, CASE WHEN g - (r + b) / 2 > 0.04 THEN 'green' WHEN g - (r + b) / 2 < -0.04 THEN 'magenta' ELSE 'neutral' END AS tint, am < 1 AS has_transparency, aa < 0.5 AS mostly_transparent, greatest(abs(r - b), abs(g - (r + b) / 2)) > 0.06 AS color_cast FROM sv JOIN m USING (frame_id)""")
def tendencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.synthetic_pixels(spark, sf_dir)
    luma = _luma("r")
    _, sat, _ = color.rgb_to_hsv_degrees(*(F.col(f"r{c}") for c in "rgb"))
    m = px.groupBy("frame_id").agg(
        *(F.avg(f"r{c}").alias(c) for c in "rgb"), F.avg(luma).alias("luma_mean"), F.stddev_pop(luma).alias("luma_std"), F.lit(0.0).alias("luma_p05"), F.lit(1.0).alias("luma_p95"), F.lit(0.0).alias("luma_low"), F.lit(0.0).alias("luma_high"),
        F.avg(sat).alias("saturation_mean"), F.min("ra").alias("alpha_min"), F.avg("ra").alias("alpha_mean"),
    )
    known = relational.color_balance(F.col("r"), F.col("g"), F.col("b")) | {c: F.col(c) for c in m.columns}
    t = relational.tendencies(known)
    return m.select("frame_id", *(t[n].alias(n) for n in ("exposure", "contrast", "saturation", "temperature", "tint", "has_transparency", "mostly_transparent", "color_cast")))


def _code(e: str) -> str:
    return f"CAST(round(greatest(0, least(1, {e})) * 255) AS BIGINT)"


_HEAT_SQL = f"{views.SYNTH_SQL}, t AS (SELECT *, least(1, sqrt(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3) * 4) AS t FROM px)"


@query(f"""WITH {_HEAT_SQL}, h AS (SELECT frame_id, CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN {_code('(t - 0.5) / 0.25')} ELSE 255 END AS r, CASE WHEN t < 0.25 THEN {_code('t / 0.25')} WHEN t < 0.75 THEN 255 ELSE {_code('1 - (t - 0.75) / 0.25')} END AS g, CASE WHEN t < 0.25 THEN 255 WHEN t < 0.5 THEN {_code('1 - (t - 0.25) / 0.25')} ELSE 0 END AS b FROM t)
    SELECT frame_id, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM h GROUP BY frame_id""")
def diff_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.diff_columns("heatmap", 4.0)
    return views.synthetic_pixels(spark, sf_dir).select("frame_id", *(c[k].alias(k) for k in "rgb")).groupBy("frame_id").agg(*(F.sum(k).alias(k) for k in "rgb"))


@query(f"WITH {views.SYNTH_SQL} SELECT frame_id, CAST(sum({_code('abs(rr - dr) * 4')}) AS BIGINT) AS r, CAST(sum({_code('abs(rg - dg) * 4')}) AS BIGINT) AS g, CAST(sum({_code('abs(rb - db) * 4')}) AS BIGINT) AS b, CAST(sum({_code('abs(ra - da) * 4')}) AS BIGINT) AS a FROM px GROUP BY frame_id")
def diff_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.diff_columns("absolute", 4.0, include_alpha=True)
    return views.synthetic_pixels(spark, sf_dir).select("frame_id", *(c[k].alias(k) for k in "rgba")).groupBy("frame_id").agg(*(F.sum(k).alias(k) for k in "rgba"))


@query(f"WITH {views.SYNTH_SQL} SELECT frame_id, CAST(sum({_code(f'({_DL} - {_RL}) * 4')}) AS BIGINT) AS r, CAST(sum({_code(f'({_RL} - {_DL}) * 4')}) AS BIGINT) AS b FROM px GROUP BY frame_id")
def diff_signed_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.diff_columns("signed_luma", 4.0)
    return views.synthetic_pixels(spark, sf_dir).select("frame_id", *(c[k].alias(k) for k in "rb")).groupBy("frame_id").agg(*(F.sum(k).alias(k) for k in "rb"))


@query("SELECT l_linenumber AS line, x, CAST(sum(((l_orderkey % 256) >> (x * 2)) & 3) AS BIGINT) * 85 AS lsb, CAST(sum(((l_orderkey % 256) >> (6 - x * 2)) & 3) AS BIGINT) * 85 AS msb FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS x) GROUP BY ALL")
def bitpacked_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 256).alias("byte"), F.explode(F.array(*map(F.lit, range(4)))).alias("x"))
    gray = lambda lsb: F.sum(frames.bit_packed_value(F.col("byte"), F.col("x"), 2, lsb))
    return rows.groupBy("line", "x").agg(gray(True).alias("lsb"), gray(False).alias("msb"))


# -- kernel form ------------------------------------------------------------------------------------------------


@query(f"""WITH {views.SYNTH_SQL}, s AS (SELECT frame_id, avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3) AS mse, avg((abs(rr - dr) + abs(rg - dg) + abs(rb - db)) / 3) AS mae, avg(({_RL} - {_DL}) * ({_RL} - {_DL})) AS ml FROM px GROUP BY frame_id)
    SELECT frame_id, 'mse:color' AS name, round(mse, 9) AS score FROM s UNION ALL SELECT frame_id, 'mae:color', round(mae, 9) FROM s UNION ALL SELECT frame_id, 'mse', round(ml, 9) FROM s UNION ALL SELECT frame_id, 'psnr', round({_psnr_sql('ml')}, 9) FROM s""")
def kernel_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.compare_pairs(views.frame_pairs(spark, sf_dir), "mse:color,mae:color,mse,psnr")
    return rounded(rows.select("frame_id", "name", "score"), score=9)


@query(f"""WITH {views.SYNTH_SQL}, lf AS (SELECT frame_id, y, x, {_RL} AS ref, {_DL} AS dist FROM px), {_windows_sql('lf', 'frame_id', _S, 8, str(list(range(0, _S, 8))))},
    m AS (SELECT frame_id, avg(ref) AS mx, avg(dist) AS my, var_samp(ref) AS vx, var_samp(dist) AS vy, covar_samp(ref, dist) AS c FROM lf GROUP BY frame_id), gs AS (SELECT *, (2 * c + 0.0009) / (vx + vy + 0.0009) AS cs FROM m)
    SELECT frame_id, 'ssim' AS name, round({_SSIM}, 8) AS score FROM gs UNION ALL SELECT frame_id, 'wssim', round(avg(ssim), 8) FROM ws GROUP BY frame_id""")
def kernel_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compare_pairs(views.frame_pairs(spark, sf_dir), "ssim,wssim").select("frame_id", "name", "score"), score=8)


@query()
def kernel_ms_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compare_pairs(views.frame_pairs(spark, sf_dir), "ms-ssim").select("frame_id", "name", "score"), score=8)


@query(f"""WITH {views.SYNTH_SQL}, k AS (SELECT frame_id, (rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db) AS q, ra, da FROM px)
    SELECT frame_id, 'mse:rgb-visible' AS name, round(avg(q / 3), 9) AS score, CAST(count(*) AS DOUBLE) AS pixel_count FROM k WHERE ra > 0 OR da > 0 GROUP BY frame_id UNION ALL SELECT frame_id, 'mse:rgb-opaque', round(avg(q / 3), 9), CAST(count(*) AS DOUBLE) FROM k WHERE ra >= 1 AND da >= 1 GROUP BY frame_id
    UNION ALL SELECT frame_id, 'mse:rgba', round(avg((q + (ra - da) * (ra - da)) / 4), 9), CAST(count(*) AS DOUBLE) FROM k GROUP BY frame_id""")
def kernel_render_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.compare_pairs(views.frame_pairs(spark, sf_dir), "mse:rgb-visible,mse:rgb-opaque,mse:rgba")
    return rows.select("frame_id", "name", F.round("score", 9).alias("score"), F.col("details")["pixel_count"].alias("pixel_count"))


@query(f"""WITH {views.SYNTH_SQL} SELECT CAST(frame_id % 4 AS BIGINT) AS bundle, 'f' || frame_id AS label, 'nation' AS tags, CAST(4 * count(*) AS BIGINT) AS bytes, round(avg(rr), 9) AS red FROM px GROUP BY frame_id""")
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.frame_pairs(spark, sf_dir)
    records = pairs.select((F.col("frame_id") % 4).cast("long").alias("bundle"), F.col("frame_id").alias("record_index"), F.concat(F.lit("f"), "frame_id").alias("label"), F.array(F.lit("nation")).alias("tags"), "reference.*")
    read = bundle.read_bundles(bundle.encode_bundles(records).select(F.col("bundle").cast("string").alias("path"), "content"))
    info = bundle.bundle_info(read)
    red = metrics.image_profiles(read.select("path", "label", bundle.frame_column().alias("frame"))).select("path", "label", F.get_json_object("profile", "$.channels.red.mean").cast("double").alias("red"))
    return info.join(red, ["path", "label"]).select(F.col("path").cast("long").alias("bundle"), "label", "tags", "bytes", F.round("red", 9).alias("red"))


@query("SELECT event_id, CAST(regexp_extract(props, '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE) AS score FROM events")
def external_first_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", external.first_float_column(F.col("props")).alias("score"))


@query(f"""WITH {_SUITE_SQL} SELECT 'suite' AS report_kind, label AS distorted, name AS metric, score, '{{"maxae":' || CAST(maxae AS VARCHAR) || ',"samples":' || CAST(CAST(samples AS DOUBLE) AS VARCHAR) || '}}' AS details_json FROM rows_ JOIN wide USING (suite_id, label)""")
def metric_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).withColumn("distorted", F.col("label")).withColumn("unit", F.lit("unit"))
    return sinks.metric_csv_rows(rows, "suite").select("report_kind", "distorted", "metric", "score", "details_json")


# -- more of the kernels, gates, timelines and sources -----------------------------------------------------------

ORACLE_SQL["greedy_alignment"] = f"""WITH RECURSIVE {views.TIMELINE_SQL}, d AS MATERIALIZED (SELECT idx, pts, row_number() OVER (ORDER BY pts, idx) - 1 AS k FROM td),
    r AS MATERIALIZED (SELECT idx, pts, row_number() OVER (ORDER BY pts, idx) AS i, (SELECT count(*) FROM td WHERE td.pts < tr.pts - 600) AS lo FROM tr),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS ri, CAST(NULL AS BIGINT) AS di, CAST(NULL AS DOUBLE) AS delta UNION ALL
        SELECT i, CASE WHEN gap <= 600 THEN best + 1 ELSE c END, ri, CASE WHEN gap <= 600 THEN di END, gap FROM (
            SELECT r.i, greatest(w.cur, r.lo) AS c, r.idx AS ri, coalesce(abs(r.pts - b.pts) < abs(r.pts - a.pts), FALSE) AS ahead, CASE WHEN ahead THEN b.k ELSE a.k END AS best, CASE WHEN ahead THEN b.idx ELSE a.idx END AS di, abs(r.pts - CASE WHEN ahead THEN b.pts ELSE a.pts END) AS gap
            FROM walk w JOIN r ON r.i = w.i + 1 JOIN d a ON a.k = greatest(w.cur, r.lo) LEFT JOIN d b ON b.k = a.k + 1))
    SELECT ri AS reference_index, di AS distorted_index, round(delta, 6) AS delta_seconds FROM walk WHERE di IS NOT NULL"""


def _ms_ssim_sql() -> str:
    weights = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)  # fixed values: published weights of the scales
    parts, side = [f"l0 AS (SELECT frame_id, y, x, {_RL} AS ref, {_DL} AS dist FROM px)"], _S
    for i in range(len(weights)):
        w = min(8, side)
        starts = str(sorted({*range(0, max(side - w, 0), 4), side - w}))
        stats = _windows_sql(f"l{i}", "frame_id", side, w, starts)
        for name in ("win", "wm", "wc", "ws"):
            stats = stats.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name})", f"FROM {name}{i})")
        term = "ssim" if i + 1 == len(weights) else "cs"
        parts += [stats, f"t{i} AS (SELECT frame_id, pow(greatest(0, least(1, avg({term}))), {weights[i] / sum(weights)}) AS t FROM ws{i} GROUP BY frame_id)"]
        parts.append(f"l{i + 1} AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(ref) AS ref, avg(dist) AS dist FROM l{i} GROUP BY ALL)")
        side = -(-side // 2)
    joined = " ".join(f"JOIN t{i} USING (frame_id)" for i in range(1, len(weights)))
    return f"WITH {views.SYNTH_SQL}, {', '.join(parts)} SELECT frame_id, 'ms-ssim' AS name, round({' * '.join(f't{i}.t' for i in range(len(weights)))}, 8) AS score FROM t0 {joined}"


ORACLE_SQL["kernel_ms_ssim"] = _ms_ssim_sql()


@query(f"""WITH {views.SYNTH_SQL}, e AS (SELECT frame_id, y, x, unnest([0, 1, 2]) AS c, unnest([rr - dr, rg - dg, rb - db]) AS e FROM px), t AS (SELECT frame_id, y, x, max(abs(e)) AS top, sqrt(sum(e * e)) AS norm FROM e GROUP BY ALL),
    p AS (SELECT frame_id, count(*) AS pixels, count(*) FILTER (top > 0) AS changed_pixels, count(*) FILTER (top * 255.0 > 4) AS pixels_beyond_4_lsb, max(norm) AS max_pixel_delta FROM t GROUP BY 1),
    s AS (SELECT frame_id, count(*) AS samples, count(*) FILTER (e <> 0) AS changed_samples, avg(e) AS mean_error, max(abs(e)) * 255.0 AS max_channel_delta_code, avg(abs(e)) FILTER (c = 1) AS channel_1_mae, avg(e * e) FILTER (c = 2) AS channel_2_mse FROM e GROUP BY 1)
    SELECT frame_id, CAST(samples AS DOUBLE) AS samples, CAST(pixels AS DOUBLE) AS pixel_count, CAST(changed_pixels AS DOUBLE) AS changed_pixels, CAST(changed_samples AS DOUBLE) AS changed_samples, CAST(pixels_beyond_4_lsb AS DOUBLE) AS pixels_beyond_4_lsb,
        round(max_pixel_delta, 9) AS max_pixel_delta, round(mean_error, 9) AS mean_error, round(max_channel_delta_code, 6) AS max_channel_delta_code, round(channel_1_mae, 9) AS channel_1_mae, round(channel_2_mse, 9) AS channel_2_mse, 3.0::DOUBLE AS channel_count FROM p JOIN s USING (frame_id)""")
def kernel_error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.compare_pairs(views.frame_pairs(spark, sf_dir), "mse:color")
    keys = ("samples", "pixel_count", "changed_pixels", "changed_samples", "pixels_beyond_4_lsb", "max_pixel_delta", "mean_error", "max_channel_delta_code", "channel_1_mae", "channel_2_mse", "channel_count")
    out = rows.select("frame_id", *(F.col("details")[k].alias(k) for k in keys))
    return rounded(out, max_pixel_delta=9, mean_error=9, max_channel_delta_code=6, channel_1_mae=9, channel_2_mse=9)


@query(f"""WITH {views.SYNTH_SQL}, c AS (SELECT frame_id, CAST(round(ra * 255) AS INTEGER) AS a, CAST(round(da * 255) AS INTEGER) AS b FROM px)
    SELECT frame_id, count(*) FILTER (a = 0) AS transparent, count(*) FILTER (a BETWEEN 1 AND 254) AS partial, count(*) FILTER (b = 255) AS distorted_opaque, count(*) FILTER (a <> b) AS mismatch_count, CAST(max(abs(a - b)) AS BIGINT) AS max_delta, count(*) FILTER (abs(a - b) > 1) AS mismatches_beyond_one_lsb FROM c GROUP BY frame_id""")
def kernel_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.alpha_rows(views.frame_pairs(spark, sf_dir))
    return rows.select("frame_id", F.col("reference_alpha.transparent").alias("transparent"), F.col("reference_alpha.partial").alias("partial"), F.col("distorted_alpha.opaque").alias("distorted_opaque"), "mismatch_count", "max_delta", "mismatches_beyond_one_lsb")


_PAIR_LIST = "0:1, 2->3, (4,5), (7,6,70), 9, (3,3,1)"


@query(f"""WITH {views.SYNTH_SQL}, pl(pair_index, a, b) AS (VALUES (0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 7, 6), (4, 9, 9), (5, 3, 3)),
    m AS (SELECT pair_index, a, b, avg(((r.rr - d.dr) * (r.rr - d.dr) + (r.rg - d.dg) * (r.rg - d.dg) + (r.rb - d.db) * (r.rb - d.db)) / 3) AS mse FROM pl JOIN px r ON r.frame_id = a JOIN px d ON d.frame_id = b AND d.y = r.y AND d.x = r.x GROUP BY ALL)
    SELECT CAST(pair_index AS BIGINT) AS pair_index, CAST(a AS BIGINT) AS reference_index, CAST(b AS BIGINT) AS distorted_index, round(mse, 9) AS score FROM m""")
def compare_pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.frame_pairs(spark, sf_dir).withColumn("frame_index", F.col("frame_id").cast("long"))
    side = lambda c: pairs.select("frame_index", F.col(c).alias("frame"))
    rows = video.compare_listed(locators.frame_pair_table(spark, _PAIR_LIST), side("reference"), side("distorted"), "mse:color")
    return rounded(rows.select("pair_index", "reference_index", "distorted_index", "score"), score=9)


@query(f"""WITH {views.SYNTH_SQL} SELECT frame_id, CAST(frame_id // 2 AS BIGINT) AS frame_index, round(avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3), 9) AS score FROM px WHERE frame_id % 2 = 0 AND frame_id // 2 < 8 GROUP BY frame_id""")
def compare_every_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.frame_pairs(spark, sf_dir).withColumn("frame_index", F.col("frame_id").cast("long"))
    side = lambda c: pairs.select("frame_index", F.col(c).alias("frame"))
    rows = video.compare_in_order(side("reference"), side("distorted"), "mse:color", every=2, max_frames=8)
    return rounded(rows.select(F.col("frame_index").cast("int").alias("frame_id"), F.floor(F.col("frame_index") / 2).alias("frame_index"), "score"), score=9)


@query(f"""WITH {_SUITE_SQL} SELECT suite_id, bool_and(psnr >= 25 AND maxae < 0.11 AND ord % 17 <> 0) AS passed FROM wide GROUP BY suite_id""")
def suite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir)
    keys = ["suite_id", "label"]
    passed = gate.verdicts(gate.evaluate(rows, keys, ["psnr>=25", "mse.maxae<0.11"]), keys)
    failed = F.when(F.col("label").cast("int") % 17 == 0, F.lit("unreadable")).alias("error")
    return gate.suite_passed(passed.select("*", failed), ["suite_id"])


@query(f"""WITH {views.SYNTH_SQL}, m AS (SELECT frame_id, avg(((rr - dr) * (rr - dr) + (rg - dg) * (rg - dg) + (rb - db) * (rb - db)) / 3) AS mse, max(greatest(abs(rr - dr), abs(rg - dg), abs(rb - db))) * 255.0 AS top, count(*) FILTER (ra <> da) AS bad FROM px GROUP BY frame_id), s AS (SELECT *, {_psnr_sql('mse')} AS psnr FROM m)
    SELECT frame_id, 'psnr:color' AS name, round(psnr, 9) AS score, NOT (psnr < 9) AND NOT (top > 240) AND bad <= 1600 AS passed, CAST((psnr < 9)::INT + (top > 240)::INT + (bad > 1600)::INT AS INTEGER) AS failures FROM s""")
def image_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.frame_pairs(spark, sf_dir)
    rows = metrics.compare_pairs(pairs, "mse,psnr:color")
    out = gate.image_gate(rows, ["frame_id"], gate.ImageThresholds("color", 9.0, 240.0, None, 1600, None), metrics.alpha_rows(pairs))
    return out.select("frame_id", "name", F.round("score", 9).alias("score"), "passed", F.size("failures").alias("failures"))


@query(f"""WITH {_SUITE_SQL}, c AS (SELECT *, psnr >= 25 AS a, mse <= 0.002 AS b FROM wide) SELECT label, a AND b AS passed, 3 AS metrics, 2 AS checks, round(psnr, 9) AS first_score, CASE WHEN a THEN '' ELSE 'psnr' END || CASE WHEN b THEN '' ELSE 'mse' END AS failed FROM c""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).withColumn("unit", F.lit("unit"))
    out = gate.report(rows, gate.evaluate(rows, ["label"], ["psnr>=25", "mse<=0.002"]), ["label"])
    failed = F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["metric"]), "")
    return out.select("label", "passed", F.size("metrics").alias("metrics"), F.size("checks").alias("checks"), F.round(F.col("metrics")[0]["score"], 9).alias("first_score"), failed.alias("failed"))


@query(f"""WITH {_SUITE_SQL}, ru AS (SELECT label, unnest([0, 1, 2]) AS rule_index FROM wide)
    SELECT label, CAST(rule_index AS INTEGER) AS rule_index, FALSE AS passed, TRUE AS named FROM ru""")
def gate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir).drop("suite_id")
    checks = gate.evaluate(rows, ["label"], ["ssim>=baseline", "psnr.none<=baseline*2", "wssim.none<=baseline"], baseline="000000001")
    return checks.select("label", "rule_index", "passed", F.col("message").contains("was not produced").alias("named"))


@query(f"""WITH {views.SYNTH_SQL}, f AS (SELECT frame_id, frame_id % 4 AS bundle, row_number() OVER (PARTITION BY frame_id % 4 ORDER BY frame_id) - 1 AS i, CASE WHEN frame_id % 3 = 0 THEN 'third' ELSE 'other' END AS tag FROM (SELECT DISTINCT frame_id FROM px)),
    t AS (SELECT bundle, min(i) AS i FROM f WHERE tag = 'third' GROUP BY bundle) SELECT CAST(f.bundle AS BIGINT) AS bundle, 'tag' AS found, 'f' || frame_id AS label FROM f JOIN t ON f.bundle = t.bundle AND f.i = t.i UNION ALL SELECT CAST(bundle AS BIGINT), 'index', 'f' || frame_id FROM f WHERE i = 2""")
def bundle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.frame_pairs(spark, sf_dir)
    tag = F.array(F.when(F.col("frame_id") % 3 == 0, F.lit("third")).otherwise("other"))
    records = pairs.select((F.col("frame_id") % 4).cast("long").alias("bundle"), F.col("frame_id").alias("record_index"), F.concat(F.lit("f"), "frame_id").alias("label"), tag.alias("tags"), "reference.*")
    read = bundle.read_bundles(bundle.encode_bundles(records).select(F.col("bundle").cast("string").alias("path"), "content"))
    part = lambda df, kind: df.select(F.col("path").cast("long").alias("bundle"), F.lit(kind).alias("found"), "label")
    return part(bundle.by_tag(read, "third"), "tag").union(part(bundle.by_index(read, 2), "index"))


@query(f"""WITH {_NEAREST_SQL}, s AS (SELECT count(*) AS n, avg(rp - dp) AS ms, avg(abs(rp - dp)) AS ma, sqrt(avg((rp - dp) * (rp - dp))) AS rms, max(abs(rp - dp)) AS mx FROM pairs),
    u AS (SELECT (SELECT count(*) FROM tr WHERE idx NOT IN (SELECT ri FROM pairs)) AS ur, (SELECT count(*) FROM td WHERE idx NOT IN (SELECT di FROM pairs)) AS ud)
    SELECT 'alignment' AS scope, unnest(['alignment_planned_pairs', 'alignment_unmatched_reference_frames', 'alignment_unmatched_distorted_frames', 'alignment_timestamp_scale', 'alignment_timestamp_offset', 'alignment_mean_signed_residual', 'alignment_mean_absolute_residual', 'alignment_rms_residual', 'alignment_max_residual']) AS name,
        unnest([n, ur, ud, 1.0, 0.0, round(ms, 6), round(ma, 6), round(rms, 6), round(mx, 6)]::DOUBLE[]) AS score FROM s, u""")
def alignment_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = (x.withColumn("video", F.lit(1)) for x in views.timelines(spark, sf_dir))
    pairs = timeline.nearest_with_reuse(r, d, ["video"], 600.0)
    fixed = spark.createDataFrame([(1, 1.0, 0.0)], "video int, scale double, offset double")
    rows = timeline.alignment_rows(pairs, ["video"], timeline.unmatched(r, pairs, ["video"], "reference"), timeline.unmatched(d, pairs, ["video"], "distorted"), fixed)
    return rounded(rows.select("scope", "name", "score"), score=6)


@query("""SELECT event_id, round(CASE WHEN event_id % 5 <> 0 THEN value WHEN event_id % 3 <> 0 THEN coalesce(CASE WHEN event_id % 7 <> 0 THEN 2.5 END, 0) + event_id / 25.0 END, 9) AS pts_effective, CASE WHEN event_id % 5 <> 0 THEN round(value, 9) END AS pts_exact FROM events""")
def effective_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    info = e.select("event_id", i.alias("frame_index"), F.when(i % 5 != 0, F.col("value")).alias("pts_seconds"), F.when(i % 7 != 0, F.lit(2.5)).alias("start_seconds"), F.when(i % 3 != 0, F.lit(25.0)).otherwise(0.0).alias("avg_rate"))
    out = timeline.effective_pts(info).select("event_id", "pts_effective", F.nullif("pts_exact", F.lit(float("nan"))).alias("pts_exact"))
    return rounded(out, pts_effective=9, pts_exact=9)


@query(f"""WITH {views.SYNTH_SQL} SELECT 'n' || frame_id AS path, round(avg(rr), 9) AS red, round(avg(rb), 9) AS blue FROM px GROUP BY frame_id""")
def raw_frame_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.frame_pairs(spark, sf_dir).select(F.concat(F.lit("n"), "frame_id").alias("path"), F.col("reference.planes")[0]["data"].alias("content"))
    read = frames.raw_frames(files, views.SIDE, views.SIDE, "rgba8").where("error is null").select("path", "frame")
    mean = lambda c: F.round(F.get_json_object("profile", f"$.channels.{c}.mean").cast("double"), 9).alias(c)
    return metrics.image_profiles(read).select("path", mean("red"), mean("blue"))
