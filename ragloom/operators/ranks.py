"""Ranks inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group is cut into at the quantiles of its order.
PARTS = 64


def ranked_in_groups(df: DataFrame, group: str, by: Column, *ties: str | Column, most: int | Column | None = None, keep_rest: bool = False) -> DataFrame:
    """Adds place, from 1, of each row of a group in the order of a number and then of ``ties``.

    One aggregate that combines before the shuffle finds the quantiles of each
    group; counts of the parts between them give each part its first place, so
    rows are only numbered inside parts, in as many tasks.  With ``most``, parts
    that begin beyond that place are not numbered: their rows go, or stay with a
    null place.  Rows of one number lie in one part.
    """
    d = df.withColumn("_by", by)
    cuts = d.groupBy(group).agg(F.percentile_approx("_by", [k / PARTS for k in range(1, PARTS)], 4 * PARTS).alias("_cuts"))
    d = d.join(cuts, group).withColumn("_part", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_by")))).drop("_cuts")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_size"))
    d = d.join(counts, [group, "_part"])
    inside = Window.partitionBy(group, "_part").orderBy("_by", *ties)
    place = (F.col("_before") + F.row_number().over(inside)).cast("long")
    if most is None:
        return d.withColumn("place", place).drop("_by", "_part", "_before", "_size")
    near = F.col("_before") < most
    numbered = d.where(near).withColumn("place", place)
    numbered = numbered.withColumn("place", F.when(F.col("place") <= most, F.col("place")))
    out = numbered.unionByName(d.where(~near).withColumn("place", F.lit(None).cast("long"))) if keep_rest else numbered.where("place is not null")
    return out.drop("_by", "_part", "_before", "_size")
