"""Vocabularies and id sequences."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.text import tokens
from ragloom.session import shared_dir, stash, text_batches

#: Items of a chunk whose distinct ones are looked up once, and rows of an Arrow batch that goes back to Spark.
CHUNK, ROWS, TERMS = 2 << 20, 2000, 1 << 17


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, idx): distinct lower-case words numbered from 1 in order.

    The sort deals ranges of words out to partitions; each word is numbered in
    its range and moved on by the counts of the ranges before, so no task sees
    the whole vocabulary.  Ranges are written once, so that both uses agree.
    """
    words = df.select(F.explode(tokens(F.lower(text))).alias("word")).distinct().repartitionByRange("word")
    words = stash(words.withColumn("range", F.spark_partition_id()), "vocabulary")
    counts = words.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("word"))
    return words.withColumn("place", inside).join(counts.select("range", before.alias("first")), "range").select("word", (F.col("place") + F.col("first")).alias("idx"))


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, ids): ids of the lower-case words in order, 0 for unknown ones; a row for each row."""
    rows, terms = _coded(df.select(key, tokens(F.lower(text)).alias("items")), key)
    return _spelled(rows, _numbers(terms, vocab), key, "ids", T.ArrayType(T.LongType()))


def decode(df: DataFrame, key: str, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """(key, text): words of the ids in order; 0 and ids out of range are dropped, and rows that have no other."""
    rows, terms = _coded(df.select(key, F.col(ids).alias("items")), key)
    return _spelled(rows, _words(terms.withColumnRenamed("item", "idx"), vocab), key, "text", T.StringType())


def recode(df: DataFrame, key: str, text: str, vocab: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """(key, text): what decode() gives for the ids of encode() after a change of each; ids are looked up, changed and turned back once for a chunk."""
    rows, terms = _coded(df.select(key, tokens(F.lower(text)).alias("items")), key)
    terms = _numbers(terms, vocab).select("chunk", "code", change(F.col("value")).alias("idx"))
    return _spelled(rows, _words(terms, vocab), key, "text", T.StringType())


def _numbers(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    known = vocab.select(F.col("word").alias("item"), F.col("idx").alias("value"))
    return terms.join(known, "item", "left").select("chunk", "code", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def _words(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    return terms.join(vocab.select("idx", F.col("word").alias("value")), "idx").select("chunk", "code", "value")


def _coded(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (chunk, key, codes) and terms (chunk, code, item) of a frame (key, items).

    A task cuts its rows into chunks of about CHUNK items and numbers the
    distinct ones of each, so what follows shuffles and looks up an item once
    for a chunk, not once for each place.  Written once, so that rows and terms agree.
    """
    spark = df.sparkSession
    text_batches(spark, ROWS)
    item, most = df.schema["items"].dataType.elementType, CHUNK
    schema = T.StructType().add("terms", "boolean").add("chunk", "long").add(key, df.schema[key].dataType).add("codes", "binary").add("code", "integer").add("item", item)
    types = [pa.bool_(), pa.int64(), None, pa.binary(), pa.int32(), None]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, run in enumerate(_runs(batches, most)):
            keys, lists = (pa.concat_arrays(c.chunks) for c in run.columns)
            types[2], types[5] = keys.type, lists.type.value_type
            d = lists.flatten().dictionary_encode()
            places = d.indices.fill_null(-1).to_numpy().astype("<i4").tobytes()
            ends = 4 * np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
            codes = pa.array([places[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
            numbers = pa.array(np.arange(len(d.dictionary), dtype=np.int32))
            for is_term, step, held in ((False, ROWS, {2: keys, 3: codes}), (True, TERMS, {4: numbers, 5: d.dictionary})):
                whole = len(next(iter(held.values())))
                for at in range(0, whole, step):
                    m = min(step, whole - at)
                    fixed = {0: pa.repeat(pa.scalar(is_term), m), 1: pa.repeat(pa.scalar(first + n, pa.int64()), m)}
                    columns = [fixed[k] if k in fixed else held[k].slice(at, m) if k in held else pa.nulls(m, t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    path = f"{shared_dir(spark).rstrip('/')}/coded-{uuid.uuid4().hex}"
    df.select(key, "items").mapInArrow(code, schema).write.partitionBy("terms").parquet(path)
    part = lambda: spark.read.schema(schema).parquet(path)
    return part().where("not terms").select("chunk", key, "codes"), part().where("terms").select("chunk", "code", "item")


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to about so many items."""
    run, size = [], 0
    for b in batches:
        run.append(b)
        size += len(b.column(1).flatten())
        if size >= most:
            yield pa.Table.from_batches(run)
            run, size = [], 0
    if run and sum(map(len, run)):
        yield pa.Table.from_batches(run)


def _spelled(rows: DataFrame, terms: DataFrame, key: str, name: str, kind: T.DataType) -> DataFrame:
    """(key, name): arrays of the values (chunk, code, value) that the codes stand for; or texts of them, for rows that have any.  Codes without a value are dropped."""
    text = isinstance(kind, T.StringType)

    def spell(rows: pa.Table, terms: pa.Table) -> pa.Table:
        keys, value = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (rows.column(key), terms.column("value")))
        blobs = rows.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(blobs), "<i4")
        known = terms.column("code").to_numpy()
        # The last place is for codes of missing items, which are -1.
        place = np.full(max(codes.max(initial=-1), known.max(initial=-1)) + 2, -1, np.int64)
        place[known] = np.arange(len(known))
        at = place[codes]
        found = np.concatenate([[0], np.cumsum(at >= 0)])
        ends = found[np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value.take(pa.array(at[at >= 0])))
        if text:
            some = pa.array(np.diff(ends) > 0)
            keys, lists = keys.filter(some), pc.binary_join(lists.filter(some), " ")
        return pa.table([keys, lists], names=[key, name])

    schema = T.StructType().add(key, rows.schema[key].dataType).add(name, kind)
    return rows.groupBy("chunk").cogroup(terms.groupBy("chunk")).applyInArrow(spell, schema)
