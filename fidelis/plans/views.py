"""Sample views over plain tables, each built alike by Spark and by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices before and after discount as sample pairs; suppliers are candidates."""
    li = table(spark, sf_dir, "lineitem")
    ref = F.col("l_extendedprice") / 105000.0
    return li.select(F.col("l_suppkey").alias("candidate"), ((F.col("l_linenumber") - 1) % 4).alias("channel"), ref.alias("ref"), (ref * (1 - F.col("l_discount"))).alias("dist"))


PRICE_SQL = "price AS (SELECT l_suppkey AS candidate, (l_linenumber - 1) % 4 AS channel, l_extendedprice / 105000.0 AS ref, l_extendedprice / 105000.0 * (1 - l_discount) AS dist FROM lineitem)"


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 frames, each against the next of its label."""
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("a"), F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")
    each = pairs.select("pair_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "s"))
    value = lambda c: (F.col(c).cast("double") + 1.0) / 2.0
    return each.select("pair_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.lit(0).alias("channel"), value("s.a").alias("ref"), value("s.b").alias("dist"))


EMBEDDING_SQL = """emb_pairs AS (SELECT vec_id AS pair_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    emb_rows AS (SELECT pair_id, unnest(a) AS av, unnest(b) AS bv, unnest(range(len(a))) AS i FROM emb_pairs WHERE b IS NOT NULL),
    emb AS (SELECT pair_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, 0 AS channel, (CAST(av AS DOUBLE) + 1.0) / 2.0 AS ref, (CAST(bv AS DOUBLE) + 1.0) / 2.0 AS dist FROM emb_rows)"""


def timelines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """View events as the reference's clock, click events as the distorted one's."""
    e = table(spark, sf_dir, "events").withColumn("pts_seconds", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6)
    side = lambda kind: e.where(F.col("event_type") == kind).select(F.col("event_id").alias("index"), "pts_seconds")
    return side("view"), side("click")


TIMELINE_SQL = """ev AS (SELECT event_id AS idx, event_type, (epoch_us(ts) - 1704067200000000) / 1e6 AS pts FROM events),
    tr AS (SELECT idx, pts FROM ev WHERE event_type = 'view'), td AS (SELECT idx, pts FROM ev WHERE event_type = 'click')"""


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as metric series, one per type, some scores not finite."""
    e = table(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    direction = F.when(F.col("event_type").isin("error", "click"), "lower").when(F.col("event_type") == "view", "neutral").otherwise("higher")
    pts = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 6e8) * 600.0
    return e.select(F.col("event_type").alias("name"), F.col("event_id").alias("frame_index"), pts.alias("pts_seconds"), score.alias("score"), F.lit("unit").alias("unit"), direction.alias("direction"))


SERIES_SQL = """series AS (SELECT event_type AS name, event_id AS frame_index, floor((epoch_us(ts) - 1704067200000000) / 6e8) * 600.0 AS pts,
        CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS score,
        CASE WHEN event_type IN ('error', 'click') THEN 'lower' WHEN event_type = 'view' THEN 'neutral' ELSE 'higher' END AS direction FROM events),
    fin AS (SELECT * FROM series WHERE NOT isnan(score) AND NOT isinf(score))"""


def synthetic_pixels(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Generated rgba pixels (0..1) of a frame pair per nation: rr, rg, rb, ra and dr, dg, db, da."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame_id"), ((F.col("n_nationkey") * 7) % 256).alias("p"))
    g = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    g = g.select("frame_id", "p", F.floor(F.col("i") / side).cast("int").alias("y"), (F.col("i") % side).alias("x"))
    x, y, p = F.col("x"), F.col("y"), F.col("p")

    def rgba(q, k):  # noqa: ANN001, ANN202
        a = F.when((x + y + p) % 7 == k, 0).when((x * 3 + y) % 11 == k, 128).otherwise(255)
        return [(x + q) % 256, (y * 3 + q) % 256, (x + y + q) % 256, a]

    codes = [*zip("rgba", rgba(p, 0), strict=True), *zip("rgba", rgba(p + 17, 1), strict=True)]
    return g.select("frame_id", "y", "x", *((c / 255.0).alias(("r" if i < 4 else "d") + k) for i, (k, c) in enumerate(codes)))


SYNTH_SQL = f"""grid AS (SELECT n_nationkey AS frame_id, (n_nationkey * 7) % 256 AS p, CAST(i // {SIDE} AS INTEGER) AS y, CAST(i % {SIDE} AS INTEGER) AS x FROM nation, range({SIDE * SIDE}) t(i)),
    px AS (SELECT frame_id, y, x, (x + p) % 256 / 255.0 AS rr, (y * 3 + p) % 256 / 255.0 AS rg, (x + y + p) % 256 / 255.0 AS rb,
        (CASE WHEN (x + y + p) % 7 = 0 THEN 0 WHEN (x * 3 + y) % 11 = 0 THEN 128 ELSE 255 END) / 255.0 AS ra,
        (x + p + 17) % 256 / 255.0 AS dr, (y * 3 + p + 17) % 256 / 255.0 AS dg, (x + y + p + 17) % 256 / 255.0 AS db,
        (CASE WHEN (x + y + p) % 7 = 1 THEN 0 WHEN (x * 3 + y) % 11 = 1 THEN 128 ELSE 255 END) / 255.0 AS da FROM grid)"""


def frame_pairs(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """The same pixels packed into rgba8 frames: (frame_id, reference, distorted)."""
    px = synthetic_pixels(spark, sf_dir, side)
    byte = lambda c: F.lpad(F.hex(F.round(F.col(c) * 255).cast("int")), 2, "0")

    def packed(s: str):  # noqa: ANN202
        hexes = F.concat(*(byte(f"{s}{c}") for c in "rgba"))
        return F.sort_array(F.collect_list(F.struct("y", "x", hexes.alias("h"))))

    rows = px.groupBy("frame_id").agg(packed("r").alias("r"), packed("d").alias("d"))
    fmt = F.struct(F.lit("rgba8").alias("pixel_format"), F.lit("srgb").alias("color_space"), F.lit("srgb").alias("transfer"), F.lit("full").alias("range"))

    def frame(c: str):  # noqa: ANN202
        data = F.unhex(F.array_join(F.transform(c, lambda v: v["h"]), ""))
        return F.struct(F.lit(side).alias("width"), F.lit(side).alias("height"), fmt.alias("format"), F.array(F.struct(data.alias("data"), F.lit(4 * side).alias("stride"))).alias("planes"))

    return rows.select("frame_id", frame("r").alias("reference"), frame("d").alias("distorted"))
