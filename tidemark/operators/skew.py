"""Splitting of hot keys for ordered computations.

A window over one key runs in one task. For keys that hold a large part of the rows, the operators here cut the key's
order axis into blocks and put copies of the neighbouring rows ("halo") into each block, so that what a window computes
inside a block equals what it would compute over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of N rows, a key that is not among the MAX_HOT most frequent has fewer than N / MAX_HOT rows. This bounds what is broadcast.
MAX_HOT = 10_000
#: Keys with fewer rows are not split: one task orders so many narrow rows within a second or two.
HOT_ROWS = 200_000
SEGMENTS, SUB_BLOCKS = 32, 32
CUTS = "_hot {}, _cuts array<bigint>"


def hot_keys(df: DataFrame, key: str, order: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame | None:
    """The keys with at least ``hot_rows`` rows, with approximate quantiles of ``order`` for each; None when there are none.

    Columns: ``_hot`` (the key), ``_cuts`` (array of bigint). Keys are counted in one narrow pass with partial aggregation;
    at most ``max_hot`` counts reach the driver. Only where there are some, a second pass reads their rows.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("_hot"), F.col(order).alias("_order"))
    counts = rows.groupBy("_hot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    top = counts.orderBy(F.desc("_n"), "_hot").limit(max_hot).select("_hot").collect()
    if not top:
        return None
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    names = spark.createDataFrame(top, f"_hot {kind}")
    shares = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    cuts = rows.join(F.broadcast(names), "_hot").groupBy("_hot").agg(F.percentile_approx("_order", shares, 1000).alias("_cuts"))
    return spark.createDataFrame(cuts.collect(), CUTS.format(kind))


def _block_of(t: Column, cuts: Column) -> Column:
    """Segment between two quantiles, cut again into equal widths; rises with ``t``."""
    seg = F.least(F.greatest(F.size(F.filter(cuts, lambda c: c <= t)) - 1, F.lit(0)), F.lit(SEGMENTS - 1))
    lo, hi = F.element_at(cuts, seg + 1), F.element_at(cuts, seg + 2)
    width = F.greatest((hi - lo).cast("double"), F.lit(1.0))
    sub = F.floor((t - lo).cast("double") * F.lit(float(SUB_BLOCKS)) / width)
    sub = F.least(F.greatest(sub, F.lit(0)), F.lit(SUB_BLOCKS - 1))
    return (seg * SUB_BLOCKS + sub).cast("int")


def with_blocks(df: DataFrame, key: str, order: str, hot: DataFrame | None) -> DataFrame:
    """Adds ``_blk``: -1 for keys that are not hot, else the number of the block of the key's ``order`` axis."""
    if hot is None:
        return df.withColumn("_blk", F.lit(-1))
    j = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    blk = F.when(F.col("_hot").isNull() | F.col(order).isNull(), F.lit(-1)).otherwise(_block_of(F.col(order), F.col("_cuts")))
    return j.withColumn("_blk", blk).drop("_hot", "_cuts")


def within(key: str, hot: DataFrame | None) -> list[str]:
    """What ordered work is partitioned by: the key, and its blocks where there are any."""
    return [key] if hot is None else [key, "_blk"]


def neighbours(df: DataFrame, key: str, order: str, fields: list[str], hot: DataFrame | None) -> DataFrame:
    """Adds ``_prev`` and ``_next``: the row before and after in ``order`` of the same key, as structs of ``fields``.

    ``df`` needs ``_blk`` of :func:`with_blocks` with the same ``hot``, and ``order`` must be unique in a key. Only the first
    and last rows of hot blocks travel between blocks. Null keys are one key.
    """
    row = F.struct(*[F.col(c) for c in fields])
    wb = Window.partitionBy(*within(key, hot)).orderBy(order)
    beside = {"_prev": F.lag("_row").over(wb), "_next": F.lead("_row").over(wb)}
    if hot is None:
        return df.withColumn("_row", row).withColumns(beside).drop("_row")
    ends = (
        df.where(F.col("_blk") >= 0)
        .groupBy(key, "_blk")
        .agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    )
    w = Window.partitionBy(key).orderBy("_blk")
    before = F.struct(F.lag("_last").over(w).alias("r"), F.lag("_hi").over(w).alias("t"))
    after = F.struct(F.lead("_first").over(w).alias("r"), F.lead("_lo").over(w).alias("t"))
    halo = ends.select(key, "_blk", before.alias("_b"), after.alias("_a")).select(key, "_blk", F.explode(F.array("_b", "_a")).alias("_h")).where(F.col("_h.t").isNotNull())
    halo = halo.select(key, "_blk", F.col("_h.t").alias(order), F.col("_h.r").alias("_row"), F.lit(True).alias("_halo"))
    both = df.withColumns({"_row": row, "_halo": F.lit(False)}).unionByName(halo, allowMissingColumns=True)
    return both.withColumns(beside).where(~F.col("_halo")).drop("_row", "_halo")
