"""Ranking metrics over (q, d, sim) and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import tokens


def ranked(s: DataFrame) -> DataFrame:
    """Adds rank: similarity down, smaller item first among equals."""
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "d")).cast("long"))


def hits(r: DataFrame, hit: Column) -> DataFrame:
    """Adds hit (0/1), and the number of relevant items of each query."""
    return r.withColumn("hit", hit.cast("int")).withColumn("relevant", F.sum("hit").over(Window.partitionBy("q")))


def at_k(h: DataFrame, k: int) -> DataFrame:
    """(k, precision, recall, rr, ndcg): means over queries at each of 1..k.

    Gains are binary; the ideal list starts with min(relevant, k) hits.
    """
    top = h.where(F.col("rank") <= k).select("q", "rank", "hit", "relevant")
    grid = top.withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(k).cast("long"))))
    per = grid.groupBy("q", "k").agg(F.sum("hit").alias("n"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.max("relevant").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("relevant", "k")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    per = per.withColumn("ndcg", F.when(F.col("relevant") > 0, F.col("dcg") / ideal).otherwise(0.0))
    return per.groupBy("k").agg(
        F.avg(F.col("n") / F.col("k")).alias("precision"),
        F.avg(F.when(F.col("relevant") > 0, F.col("n") / F.col("relevant")).otherwise(0.0)).alias("recall"),
        F.avg((F.col("n") > 0).cast("double")).alias("rr"),
        F.avg("ndcg").alias("ndcg"),
    )


def reciprocal_rank(h: DataFrame) -> DataFrame:
    """(q, rr): one over the rank of the first relevant item, 0 if there is none."""
    return h.groupBy("q").agg(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))


def graded_ndcg(r: DataFrame, rel: str, *ks: int) -> DataFrame:
    """(q, ndcg) with numeric relevance, or (q, ndcg1, ndcg5, ...) of several k in one pass; 0 if the ideal is 0."""
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    w = Window.partitionBy("q").orderBy(F.desc(rel), "d")
    rows = r.withColumn("_ideal", F.row_number().over(w))

    def at(k: int) -> Column:
        dcg = F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)))
        best = F.sum(F.when(F.col("_ideal") <= k, gain / F.log2(F.col("_ideal") + 1)))
        return F.when(best > 0, dcg / best).otherwise(0.0)

    return rows.groupBy("q").agg(*[at(k).alias("ndcg" if len(ks) == 1 else f"ndcg{k}") for k in ks])


def rank_summary(ranks: DataFrame) -> DataFrame:
    """R@1, R@5, R@10, median and mean rank of a (q, rank) table."""
    share = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.agg(share(1).alias("r1"), share(5).alias("r5"), share(10).alias("r10"), F.floor(F.expr("percentile(rank, 0.5)")).alias("median_rank"), F.avg("rank").alias("mean_rank"))


def shared_word_jaccard(q: DataFrame, d: DataFrame) -> DataFrame:
    """(q, d, jaccard): word Jaccard of all pairs that share a word, by a join on words; it is 0 for every other pair."""
    qw = q.select("q", F.explode(F.array_distinct(tokens(F.lower("qt")))).alias("w"))
    dw = d.select("d", F.explode(F.array_distinct(tokens(F.lower("dt")))).alias("w"))
    nq, nd = qw.groupBy("q").agg(F.count(F.lit(1)).alias("nq")), dw.groupBy("d").agg(F.count(F.lit(1)).alias("nd"))
    common = qw.join(dw, "w").groupBy("q", "d").agg(F.count(F.lit(1)).alias("n")).join(nq, "q").join(nd, "d")
    return common.select("q", "d", (F.col("n") / (F.col("nq") + F.col("nd") - F.col("n"))).alias("jaccard"))


def nearest_texts(q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """(q, qt, d, dt, jaccard, rank): texts nearest to each query by word Jaccard.

    Shared words come from a join on words; texts without any fill up by id.
    """
    near = shared_word_jaccard(q, d)
    filler = q.select("q").crossJoin(F.broadcast(d.select("d").orderBy("d").limit(k))).withColumn("jaccard", F.lit(0.0))
    both = near.union(filler.join(near, ["q", "d"], "left_anti"))
    top = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("jaccard"), "d")).cast("long")).where(F.col("rank") <= k)
    return top.join(q, "q").join(d, "d")


def contrastive(s: DataFrame, batch: str, scale: float) -> DataFrame:
    """(batch, loss, accuracy) of two-way in-batch contrast; s has (batch, i, j, sim) for all pairs of a batch."""
    x = s.withColumn("x", F.col("sim") * scale)
    side = []
    for a, b in (("i", "j"), ("j", "i")):
        m = x.groupBy(batch, a).agg(F.max("x").alias("top"), F.max_by(b, F.struct("x", (-F.col(b)).alias("n"))).alias("best"))
        z = x.join(m, [batch, a]).groupBy(batch, a).agg(
            (F.log(F.sum(F.exp(F.col("x") - F.col("top")))) + F.max("top") - F.max(F.when(F.col("i") == F.col("j"), F.col("x")))).alias("loss"), F.max((F.col("best") == F.col(a)).cast("double")).alias("ok")
        )
        side.append(z.select(batch, "loss", "ok"))
    both = side[0].union(side[1])
    return both.groupBy(batch).agg(F.avg("loss").alias("loss"), F.avg("ok").alias("accuracy"))


def violations(s: DataFrame, margin: float, semi_hard: bool = False) -> DataFrame:
    """(side, id, violation): the hardest margin violation of each row and column of a score table with (i, j, sim)."""
    own = s.where("i = j").select(F.col("i").alias("k"), F.col("sim").alias("positive"))
    out = []
    for side in ("i", "j"):
        x = s.where("i <> j").join(own, F.col(side) == F.col("k"))
        cost = F.greatest(F.lit(margin) + F.col("sim") - F.col("positive"), F.lit(0.0))
        if semi_hard:
            cost = F.when(F.col("sim") <= F.col("positive"), cost).otherwise(0.0)
        out.append(x.groupBy(F.col(side).alias("id")).agg(F.max(cost).alias("violation")).select(F.lit(side).alias("side"), "id", "violation"))
    return out[0].union(out[1])


def mined_negatives(s: DataFrame, margin: float) -> DataFrame:
    """(batch, i, j, kind): semi-hard negatives d(i,i) < d(i,j) < d(i,i) + margin, or hard ones where a batch has no semi-hard."""
    own = s.where("i = j").select("batch", "i", F.col("dist").alias("own"))
    x = s.where("i <> j").join(own, ["batch", "i"])
    x = x.withColumn("kind", F.when((F.col("dist") > F.col("own")) & (F.col("dist") < F.col("own") + margin), "semi").when(F.col("dist") < F.col("own"), "hard")).where("kind is not null")
    semi = F.max((F.col("kind") == "semi").cast("int")).over(Window.partitionBy("batch"))
    return x.withColumn("any_semi", semi).where("kind = 'semi' or any_semi = 0").select("batch", "i", "j", "kind")
