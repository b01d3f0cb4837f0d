"""Reading and writing corpora: explicit schemas, one row per line or per array element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTIONS = T.StructType(
    [T.StructField("model_id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
)
CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
VOCABULARY = T.StructType(
    [
        T.StructField("word_to_idx", T.MapType(T.StringType(), T.LongType())),
        T.StructField("captions", T.ArrayType(T.StructType([T.StructField("model", T.StringType()), T.StructField("category", T.StringType()), T.StructField("caption", T.ArrayType(T.StringType()))]))),
    ]
)
TAXONOMY = T.StructType([T.StructField("synsetId", T.StringType()), T.StructField("name", T.StringType())])


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or lines) of captions, each stripped."""
    return spark.read.schema(CAPTIONS).json(path, multiLine=True).withColumn("caption", F.trim("caption"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """JSON lines; obj_id repeats the category, as readers of the format expect."""
    df.withColumn("obj_id", F.col("category")).write.json(path)


def write_structured(df: DataFrame, path: str) -> None:
    """A corpus as two parts: entries, and one row of metadata beside them."""
    entries, about = f"{path}/entries", f"{path}/metadata"
    df.write.json(entries)
    names = lambda c: F.array_sort(F.collect_set(c))
    df.agg(F.count(F.lit(1)).alias("total_entries"), names("category").alias("categories"), names("source").alias("sources"), F.avg("confidence").alias("average_confidence")).write.json(about)


def read_structured(spark: SparkSession, path: str, entries: str) -> tuple[DataFrame, DataFrame]:
    """Entries, given their schema, and the row of metadata."""
    about = "total_entries long, categories array<string>, sources array<string>, average_confidence double"
    return spark.read.schema(entries).json(f"{path}/entries"), spark.read.schema(about).json(f"{path}/metadata")


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds metric rows to those already written, as CSV with a header."""
    df.write.mode("append").option("header", True).csv(path)


def write_predictions(df: DataFrame, lookup: DataFrame, path: str, frame: str = "frame", label: str = "label") -> None:
    """Predictions by frame, a folder for each, with labels replaced by those of a lookup table (label, submitted)."""
    mapped = df.join(lookup.select(F.col("label").alias(label), "submitted"), label)
    mapped.drop(label).repartition(frame).write.partitionBy(frame).parquet(path)


def read_vocabulary_captions(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Captions of one category from a vocabulary file, tokens joined to a sentence."""
    c = spark.read.schema(VOCABULARY).json(path, multiLine=True).select(F.explode("captions").alias("c"))
    return c.where(F.col("c.category") == category).select("c.model", F.concat_ws(" ", "c.caption").alias("text"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAXONOMY).json(path, multiLine=True).withColumn("label", F.split_part("name", F.lit(","), F.lit(1)))


def join_tokens(c: Column) -> Column:
    """Tokens of any simple type as one sentence; a plain string passes through."""
    return c if isinstance(c, str) else F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))


def class_index(labels: DataFrame, column: str = "label") -> DataFrame:
    """(label, class_idx): rank of each distinct label from 0.  Distinct labels are few, so one ordered window serves."""
    return labels.select(column).where(F.col(column).isNotNull()).distinct().withColumn("class_idx", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))


def read_labelled_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(path, label, class_idx) of files whose folder is a known label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.withColumn("label", F.element_at(F.split("path", "/"), -2))
    return files.join(class_index(known), "label")


def split_members(data: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed in a split."""
    return data.join(ids.select(key).distinct(), key, "left_semi")


def split_by_sequence(c: Column) -> Column:
    """08 validates; the other sequences up to 10 train; later ones test."""
    return F.when(c == 8, "val").when(c <= 10, "train").otherwise("test")


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, label) of a text file, one label per line, numbered by line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("class_idx", "label"))
    return lines.where("label <> ''").select(F.col("class_idx").cast("long").alias("class_idx"), F.trim("label").alias("label"))


def numbered(df: DataFrame, key: str, name: str = "row", buckets: int = 256) -> DataFrame:
    """Rows numbered from 0 in the order of a key, without one task seeing all.

    Keys are cut into ranges by quantiles; rows are numbered inside their range
    and shifted by the counts of the ranges before.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.001)))
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key)))
    d = df.withColumn("_range", place)
    counts = d.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy(key)
    d = d.withColumn("_n", F.row_number().over(inside) - 1).join(F.broadcast(shift), "_range")
    return d.withColumn(name, F.col("_n") + F.col("_first")).drop("_range", "_n", "_first")


def even_split(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds slice: n slices of equal size by key order, with bounds round(i * rows / n), halves to even."""
    total = df.count()
    bounds = [round(i * total / n) for i in range(n + 1)]
    rows = numbered(df, key)
    s = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[1:]]), lambda b: b <= F.col("row")))
    return rows.withColumn("slice", s.cast("long"))
