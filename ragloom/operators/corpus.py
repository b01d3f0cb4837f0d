"""Building a corpus: union with provenance, templates, caches, attributes, scores, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.automaton import terms_held
from ragloom.functions.text import is_corpus_row, md5_number, n_words, norm_ws, word_vector

#: Attribute vocabularies, matched as substrings.
ATTRIBUTES = {
    "colors": ["red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray", "grey", "brown", "beige", "cream", "navy", "maroon", "gold", "silver", "bronze", "copper"],
    "materials": ["wood", "wooden", "oak", "pine", "mahogany", "teak", "walnut", "metal", "steel", "iron", "aluminum", "brass", "copper", "plastic", "acrylic", "glass", "leather", "fabric", "cotton", "velvet", "silk", "linen", "marble", "stone", "ceramic", "bamboo", "rattan", "wicker", "upholstered"],
    "styles": ["modern", "contemporary", "vintage", "antique", "traditional", "minimalist", "industrial", "scandinavian", "mid-century", "rustic", "shabby chic", "art deco", "victorian", "baroque", "colonial", "country", "urban", "zen", "bohemian", "eclectic"],
    "functions": ["storage", "seating", "sleeping", "dining", "working", "reading", "display", "lighting", "decorative", "entertainment", "organization"],
    "shapes": ["round", "square", "rectangular", "oval", "circular", "linear", "curved", "straight", "angular", "geometric", "organic"],
    "sizes": ["small", "medium", "large", "compact", "oversized", "miniature", "full-size", "queen", "king", "twin", "single", "double"],
}
#: The smaller vocabularies, matched at word boundaries.
BOUNDARY_ATTRIBUTES = {
    "colors": ATTRIBUTES["colors"],
    "materials": ["wood", "wooden", "oak", "pine", "mahogany", "metal", "steel", "iron", "aluminum", "plastic", "acrylic", "glass", "leather", "fabric", "cotton", "velvet", "marble", "stone", "upholstered"],
    "styles": ["modern", "contemporary", "vintage", "antique", "traditional", "minimalist", "industrial", "scandinavian", "mid-century", "rustic", "art deco", "bohemian"],
    "shapes": ATTRIBUTES["shapes"],
}
#: Categories, settings and sentence templates.
CATEGORIES = ["chair", "table", "sofa", "bed", "cabinet", "shelf", "lamp", "desk", "stool", "bench", "dresser", "wardrobe", "bookshelf", "coffee table", "dining table", "armchair", "nightstand"]
SETTINGS = ["living room", "dining room", "bedroom", "office", "study"]
TEMPLATES = [
    "This {category} features a {style} design with {material} construction and {color} finish.",
    "A {style} {category} made from {material}, perfect for {function} in {setting} spaces.",
    "Contemporary {category} with {shape} form, crafted in {material} with {color} accents.",
    "Classic {category} design featuring {material} frame and {color} upholstery, ideal for {setting}.",
    "Modern {category} combining {material} and {material2} for a {style} aesthetic.",
]
CHAIR_TEMPLATES = [
    "A {style} chair with a {shape} silhouette, crafted from {material}.",
    "This {color} chair adopts a {style} vibe and uses premium {material}.",
    "Featuring clean lines, the chair comes in {color} and {material}.",
    "An elegant chair marrying {material} and {material2} for a unique presence.",
]
SLOTS = {"style": ATTRIBUTES["styles"], "material": ATTRIBUTES["materials"], "material2": ATTRIBUTES["materials"], "color": ATTRIBUTES["colors"], "shape": ATTRIBUTES["shapes"], "function": ATTRIBUTES["functions"], "setting": SETTINGS}


def pick(options: list[str], *key: Column | str) -> Column:
    """One option, drawn by md5 of the key."""
    return F.element_at(F.array(*map(F.lit, options)), (md5_number(*key) % len(options) + 1).cast("int"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), v)
    return template


def template_grid(words: DataFrame, templates: list[str] = TEMPLATES, draws: int = 20, seed: str = "0") -> DataFrame:
    """(category, template, draw, text) for each category row, every template and draw; slots are drawn by md5."""
    grid = words.withColumn("template", F.explode(F.sequence(F.lit(0), F.lit(len(templates) - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = [F.lit(seed), F.col("category"), F.col("template"), F.col("draw")]
    slots = {s: pick(v, *key, s) for s, v in SLOTS.items()}
    text = fill(F.element_at(F.array(*map(F.lit, templates)), F.col("template") + 1), {"category": F.col("category")} | slots)
    return grid.select("category", F.col("template").cast("long").alias("template"), F.col("draw").cast("long").alias("draw"), text.alias("text"))


def two_distinct(rows: DataFrame, key: str, options: list[str], seed: str = "0") -> DataFrame:
    """Adds first and second, two different options drawn by md5 of the key."""
    n = len(options)
    i = md5_number(seed, F.col(key), "first") % n
    j = md5_number(seed, F.col(key), "second") % (n - 1)
    array = F.array(*map(F.lit, options))
    j = F.when(j >= i, j + 1).otherwise(j)
    return rows.withColumn("first", F.element_at(array, (i + 1).cast("int"))).withColumn("second", F.element_at(array, (j + 1).cast("int")))


def terms(spark: SparkSession, vocab: dict[str, list[str]]) -> DataFrame:
    """(type, term) of an attribute vocabulary."""
    return spark.createDataFrame([(k, v) for k, own in vocab.items() for v in own], "type string, term string")


def _terms_of(found: Column, own: list[str]) -> Column:
    return F.array_intersect(F.array(*map(F.lit, sorted(set(own)))), found)


def _held_terms(docs: DataFrame, vocab: dict[str, list[str]], text: str, boundary: bool) -> DataFrame:
    """Adds _found, the vocabulary's terms that each text holds; the lower-cased text is made once.

    With boundary, a text's distinct words are made once and meet all one-word
    terms, with or without a final s, in one set operation; only terms of
    several words are searched for.  The row id at the end, always true, keeps
    the optimizer from working _found out anew wherever it is used.  Without
    boundary, terms are found by one walk along the text.
    """
    every = sorted({x for own in vocab.values() for x in own})
    d = docs.withColumn("_low", F.lower(text))
    if not boundary:
        return d.withColumn("_found", terms_held(F.col("_low"), every)).drop("_low")
    once = lambda found: F.when(F.monotonically_increasing_id() >= 0, found)
    plain = [x for x in every if x.isascii() and x.isalnum()]
    wide = [x for x in every if x not in plain]
    d = d.withColumn("_words", F.array_distinct(F.split("_low", "[^A-Za-z0-9_]+")))
    singular = F.transform(F.filter("_words", lambda w: w.endswith("s")), lambda w: F.substring(w, 1, F.length(w) - 1))
    vocabulary = F.array(*map(F.lit, plain))
    one = F.array_union(F.array_intersect(vocabulary, F.col("_words")), F.array_intersect(vocabulary, singular))
    search = lambda x: F.col("_low").contains(x) & F.regexp_like("_low", F.lit(f"(?:^|[^A-Za-z0-9_]){re.escape(x)}s?(?:[^A-Za-z0-9_]|$)"))
    hits = F.array_compact(F.array(*[F.when(search(x), F.lit(x)) for x in wide])) if wide else F.array().cast("array<string>")
    return d.withColumn("_found", once(F.concat(one, hits))).drop("_low", "_words")


def attributes(docs: DataFrame, vocab: dict[str, list[str]], key: str = "doc_id", text: str = "text", boundary: bool = False) -> DataFrame:
    """(key, type, values): attribute terms of each text, sorted; types without a hit are absent.

    The vocabulary is a list of constants, so each text is matched where it
    lies, without a join or a shuffle.
    """
    d = _held_terms(docs.select(key, text), vocab, text, boundary).where(F.size("_found") > 0)
    found = [F.struct(F.lit(kind).alias("type"), _terms_of(F.col("_found"), own).alias("values")) for kind, own in vocab.items()]
    rows = d.select(key, F.explode(F.array(*found)).alias("a"))
    return rows.select(key, "a.type", "a.values").where(F.size("values") > 0)


def attribute_map(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("type", "values"))).alias("attributes"))


def quality_score(confidence: Column, n_attributes: Column, words: Column, source: Column) -> Column:
    s = confidence + F.least(F.lit(0.05) * n_attributes, F.lit(0.2))
    s = s + F.when(words.between(15, 50), 0.1).when(words < 8, -0.2).otherwise(0.0) - F.when(source == "synthetic", 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def scored(docs: DataFrame, vocab: dict[str, list[str]] = ATTRIBUTES) -> DataFrame:
    """Adds n_attributes and score to (doc_id, text, source, confidence, ...); one pass, nothing shuffled."""
    n = F.lit(0)
    for own in vocab.values():
        n = n + F.size(_terms_of(F.col("_found"), own))
    d = _held_terms(docs, vocab, "text", False).withColumn("n_attributes", n.cast("long")).drop("_found")
    return d.withColumn("score", quality_score(F.col("confidence"), F.col("n_attributes"), n_words(F.col("text")), F.col("source")))


def build_corpus(rows: DataFrame, categories: list[str], vocab: dict[str, list[str]] = ATTRIBUTES, least: float = 0.5, similar: float | None = None, above: int = 1000, vector: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Normalise, filter, keep the most confident of equal texts, score, and keep good rows with the score as confidence.

    With ``similar``, rows left after that, if they are more than ``above``, also
    take turns in dropping rows whose vectors have a larger cosine; see
    drop_in_turn.  Vectors are stored ones (doc_id, v), of which a row may have
    none, or a column, or else counts of words.
    """
    from ragloom.operators.dedup import drop_in_turn, keep_best
    from ragloom.operators.vectors import similar_pairs
    from ragloom.session import stash

    clean = keep_best(rows.withColumn("text", norm_ws(F.col("text"))).where(is_corpus_row(F.col("text"), categories)))
    if similar is not None:
        clean = stash(clean, "clean-corpus")
        if clean.count() > above:
            if vectors is None:
                vectors = clean.select("doc_id", (word_vector(F.col("text")) if vector is None else vector).alias("v"))
            else:
                vectors = vectors.join(clean.select("doc_id"), "doc_id", "left_semi")
            clean = drop_in_turn(clean, similar_pairs(vectors, similar, "doc_id"), "doc_id")
    return scored(clean, vocab).where(F.col("score") >= least).withColumn("confidence", F.col("score")).drop("score")


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits, without known failures (empty values), and misses."""
    return wanted.join(cache.where("value <> ''"), key), wanted.join(cache.select(key), key, "left_anti")


def share(counts: DataFrame, column: str = "n") -> DataFrame:
    """Adds percent of the total, which is one row."""
    total = counts.agg(F.sum(column).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col(column) / F.col("_total"), 6)).drop("_total")


def top_values(counts: DataFrame, group: str, value: str, k: int = 10) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
