"""Ranks over data of any size: range partitions, places within them, and the partitions' offsets."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import UnsupportedInput

_PLACE = 1 << 33


def global_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with 0-based positions within each group of ``by`` in ascending order; equal rows in any order.

    Rows are dealt by ranges of (by, order), so that a single huge group spreads over all tasks; only a count per
    task and group is gathered by group. The ranges are sampled when they are first made, and a second sampling could
    number rows otherwise, so the dealt rows are checkpointed (``spark.checkpoint.dir``; a folder of its own in local mode).
    """
    keys = [F.col(c) for c in (*by, *order)]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise UnsupportedInput("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="fidelis-"))
    dealt = dealt.checkpoint()
    part: Column = F.floor(F.col("__m") / _PLACE)
    dealt = dealt.withColumn("__p", part)
    counts = dealt.groupBy(*by, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per task and group
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return dealt.join(F.broadcast(counts) if not by else counts, [*by, "__p"]).withColumn(name, F.col("__m") - F.col("__low") + F.col("__base")).drop("__m", "__p", "__low", "__base")
