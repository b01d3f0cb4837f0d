"""The tables that queries work on, derived from the given ones, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.plans.registry import Tables


def corpus(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 3
    return t.documents.select(
        "doc_id",
        "text",
        F.col("lang").alias("category"),
        F.when(kind == 0, "caption").when(kind == 1, "fetched").otherwise("synthetic").alias("source"),
        F.when(kind == 0, 0.9).when(kind == 1, 0.7).otherwise(0.6).alias("confidence"),
    )


CORPUS = """corpus AS (SELECT doc_id, text, lang AS category,
  CASE doc_id % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'fetched' ELSE 'synthetic' END AS source,
  CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM documents)"""


def parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("text"))


PARTS = "parts AS (SELECT p_partkey AS doc_id, lower(concat_ws(' ', p_name, p_type, p_brand)) AS text FROM part)"


def captions(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("model_id"), "turn", F.col("role").alias("category"), F.col("text").alias("caption"))


CAPTIONS = "captions AS (SELECT conv_id AS model_id, turn, role AS category, text AS caption FROM conversations)"


def emb(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label::BIGINT AS label FROM embeddings)"


def dup(t: Tables) -> DataFrame:
    """emb, plus for each even id with a successor two mixtures of both, which make chains of near neighbours."""
    e = emb(t)
    n = e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    pair = e.where("id % 2 = 0").join(n, "id")

    def mixed(k: int, a: float, b: float) -> DataFrame:
        return pair.select((F.col("id") + k * 1000000).alias("id"), F.zip_with("v", "w", lambda x, y: a * x + b * y).alias("v"), "label")

    return e.union(mixed(1, 0.95, 0.31)).union(mixed(2, 0.8, 0.6))


DUP = f"""{EMB}, pair AS (SELECT a.id, a.v, b.v AS w, a.label FROM emb a JOIN emb b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
dup AS (SELECT id, v, label FROM emb
  UNION ALL SELECT id + 1000000, list_transform(range(1, 65), lambda i: 0.95 * v[i] + 0.31 * w[i]), label FROM pair
  UNION ALL SELECT id + 2000000, list_transform(range(1, 65), lambda i: 0.8 * v[i] + 0.6 * w[i]), label FROM pair)"""


def queries_and_items(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Odd vectors ask, even ones answer; truth is the even neighbour, or the same label."""
    e = emb(t)
    q = e.where("id % 2 = 1").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("label").alias("q_label"))
    d = e.where("id % 2 = 0").select(F.col("id").alias("d"), F.col("v").alias("dv"), F.col("label").alias("d_label"))
    return q, d


RETR = f"""{EMB}, q AS (SELECT id AS q, v AS qv, label AS q_label FROM emb WHERE id % 2 = 1),
d AS (SELECT id AS d, v AS dv, label AS d_label FROM emb WHERE id % 2 = 0),
sim AS (SELECT q, d, q_label, d_label, round(list_dot_product(qv, dv), 9) AS sim FROM q, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM sim)"""


def sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Groups of eight vectors: the first five are parts, the others words."""
    e = emb(t).withColumn("g", F.floor(F.col("id") / 8)).withColumn("k", F.col("id") % 8)
    parts_ = e.where("k < 5").select(F.col("g").alias("shape"), F.col("k").alias("part"), F.col("v").alias("pv"))
    words_ = e.where("k >= 5").select(F.col("g").alias("caption"), F.col("k").alias("word"), F.col("v").alias("wv"))
    return parts_, words_


SETS = f"""{EMB}, parts AS (SELECT id // 8 AS shape, id % 8 AS part, v AS pv FROM emb WHERE id % 8 < 5),
words AS (SELECT id // 8 AS caption, id % 8 AS word, v AS wv FROM emb WHERE id % 8 >= 5)"""


def points(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z"), v[3].alias("f1"), (F.col("vec_id") % 4).alias("seg")
    )


POINTS = """points AS (SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS f1, vec_id % 4 AS seg FROM embeddings)"""


def edges(t: Tables) -> DataFrame:
    n = t.nation
    return (
        n.select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.lit("has").alias("rel"), F.concat(F.lit("N"), "n_nationkey").alias("dst"))
        .union(t.customer.select(F.concat(F.lit("N"), "c_nationkey"), F.lit("has"), F.concat(F.lit("C"), "c_custkey")))
        .union(t.supplier.select(F.concat(F.lit("N"), "s_nationkey"), F.lit("part"), F.concat(F.lit("S"), "s_suppkey")))
    )


EDGES = """edges AS (SELECT 'R' || n_regionkey AS src, 'has' AS rel, 'N' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'has', 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'part', 'S' || s_suppkey FROM supplier)"""

CLASSES = ["click", "error", "purchase", "signup", "view"]


def pred(t: Tables) -> DataFrame:
    other = F.element_at(F.array(*map(F.lit, CLASSES)), (1 + F.col("event_id") % 5).cast("int"))
    return t.events.select("event_id", (F.col("user_id") % 6).alias("area"), F.col("event_type").alias("truth"), F.when(F.col("value") < 100, F.col("event_type")).otherwise(other).alias("pred"), "value")


PRED = f"""pred AS (SELECT event_id, user_id % 6 AS area, event_type AS truth,
  CASE WHEN value < 100 THEN event_type ELSE {CLASSES}[1 + event_id % 5] END AS pred, value FROM events)"""
