"""The most frequent values of a count table, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of a (value, n) frame with the largest n, ``size`` of them at most.

    Counts fall into classes of an eighth of a power of two, some 500 of them
    whatever the input; the highest classes that together hold no more than
    ``size`` rows are taken whole.  So the driver gets one small histogram, and
    no task sends candidates of its own.  Nulls in n are left out; an empty
    frame, or one whose highest class is too large, gives no rows.
    """
    level = F.floor(F.log2(F.col("n")) * 8).cast("int")
    taken, least = 0, None
    for r in counts.where("n > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect():
        taken += r["rows"]
        if taken > size:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else (F.col("n") > 0) & (level >= least))
