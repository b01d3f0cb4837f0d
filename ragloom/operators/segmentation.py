"""Classification and segmentation metrics from rows (truth, pred) as aggregations of a confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, classes: list[str], ignore: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by, truth, pred, n) with zero cells; rows of the ignored truth go, and the class stays in the grid."""
    d = df.where(F.col("truth") != ignore) if ignore is not None else df
    counts = d.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*map(F.lit, classes))
    base = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = base.withColumn("truth", F.explode(names)).withColumn("pred", F.explode(names))
    return grid.join(counts, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_counts(c: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, class, tp, fp, fn, tn, actual, predicted, union, frequency)."""
    rows = c.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("class"), F.lit("p").alias("side")))).alias("s"), "truth", "pred", "n")
    g = rows.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum(F.when((F.col("s.side") == "t") & (F.col("truth") == F.col("pred")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    total = F.sum("actual").over(Window.partitionBy(*by))
    g = g.withColumn("total", total).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("actual") - F.col("tp"))
    g = g.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).withColumn("union", F.col("actual") + F.col("predicted") - F.col("tp"))
    return g.withColumn("frequency", F.col("actual") / F.greatest("total", F.lit(1)))


def percent(a: str, b: str, eps: float = 0.0) -> Column:
    if eps:
        return 100 * (F.col(a) + eps) / (F.col(b) + eps)
    return 100 * F.col(a) / F.greatest(F.col(b), F.lit(1))


def summary(k: DataFrame, by: list[str] = (), eps: float = 0.0) -> DataFrame:
    """(by, oa, macc, miou) in percent; with eps an absent class counts as 100."""
    d = k.withColumn("acc", percent("tp", "actual", eps)).withColumn("iou", percent("tp", "union", eps))
    return d.groupBy(*by).agg((100 * F.sum("tp") / F.greatest(F.max("total"), F.lit(1))).alias("oa"), F.avg("acc").alias("macc"), F.avg("iou").alias("miou"))


def iou_filled(k: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds iou in percent; an absent class takes the mean over present ones."""
    own = F.when(F.col("union") > 0, 100 * F.col("tp") / F.col("union"))
    return k.withColumn("iou", F.coalesce(own, F.avg(own).over(Window.partitionBy(*by))))


def cross_entropy(scores: DataFrame, smoothing: float = 0.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(loss) over rows (id, class, logit, truth); log-sum-exp by id."""
    top = scores.groupBy("id").agg(F.max("logit").alias("top"), F.count(F.lit(1)).alias("k"))
    z = scores.join(top, "id").groupBy("id", "truth").agg(
        (F.log(F.sum(F.exp(F.col("logit") - F.col("top")))) + F.max("top")).alias("lse"), F.max(F.when(F.col("class") == F.col("truth"), F.col("logit"))).alias("own"), F.avg("logit").alias("mean")
    )
    nll = F.col("lse") - (1 - smoothing) * F.col("own") - smoothing * F.col("mean")
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("truth")] if weights else F.lit(1.0)
    return z.agg((F.sum(w * nll) / F.sum(w)).alias("loss"))


def focal(scores: DataFrame, gamma: float = 2.0) -> DataFrame:
    top = scores.groupBy("id").agg(F.max("logit").alias("top"))
    z = scores.join(top, "id").groupBy("id").agg((F.max(F.when(F.col("class") == F.col("truth"), F.col("logit"))) - F.max("top") - F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))).alias("logp"))
    return z.agg(F.avg(-F.pow(1 - F.exp("logp"), gamma) * F.col("logp")).alias("loss"))
