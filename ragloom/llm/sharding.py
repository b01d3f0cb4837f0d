"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Every shard draws a number from (key, shard); the shard with the best draw takes
the record.  One more shard only adds one more draw, so a record moves only if
the new shard wins it: about 1/(n+1) of them, and never between old shards.
A draw comes from md5, which any engine reproduces, as the first 13 hex digits
(52 bits, exact in a double); with weight w it scores ``w / -ln(u)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of md5(key) that cut a shard into groups whose rows are numbered together.
SLOT_DIGITS = 3


def _draw(key: Column, shard: int, weight: float | None) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    score = bits if weight is None else F.lit(float(weight)) / -F.log((bits + 0.5) / F.lit(float(1 << 52)))
    return F.struct(score.alias("score"), F.lit(-shard).alias("neg"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard; a null key counts as the empty string, a tie goes to the lower index.

    With equal weights the draw itself is compared, as the score grows with it.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and not empty")
    key = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights)) == 1
    draws = [_draw(key, k, None if equal else w) for k, w in enumerate(weights)]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["neg"]).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 8 (null text: 8).  slot numbers a shard's
    records from 0 without gaps.  A window per shard would put a shard into one
    task, so slots are numbered inside (shard, md5 prefix) groups, and a table
    of group counts, at most shards * 16**SLOT_DIGITS rows, gives each group's
    first slot.  Repeated keys all stay (same shard, own slots); extra columns
    are not carried; an empty table gives an empty result.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight per shard")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content).cast("long") + 8).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, SLOT_DIGITS).alias("_group"),
    )
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_n", F.row_number().over(inside))
        .join(groups, ["shard", "_group"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard")
    )
