"""Corpus building, reports, text deduplication and graphs as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import text as X
from ragloom.operators import corpus as C
from ragloom.operators import dedup as D
from ragloom.operators import graph as G
from ragloom.plans.fixtures import CORPUS, EDGES, PARTS, PRED, RETR, corpus, edges, parts, pred, queries_and_items
from ragloom.plans.registry import query
from ragloom.plans.vectors import turns
from ragloom.plans.text import KB, ROW_FILTER, categories, nws, words


def lit(options: list[str]) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


def number(*key: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(key) + ")), 1, 15))::BIGINT"


def terms_sql(vocab: dict[str, list[str]]) -> str:
    return "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, own in vocab.items() for v in dict.fromkeys(own)) + ") AS v(type, term))"


def term_match(text: str, term: str, plural: bool = False) -> str:
    return f"regexp_matches(' ' || lower({text}) || ' ', '[^A-Za-z0-9_]' || lower({term}) || '{'s?' if plural else ''}[^A-Za-z0-9_]')"


@query("corpus_union", f"WITH {CORPUS} SELECT source, count(*) AS n, round(avg(confidence), 6) AS confidence FROM corpus GROUP BY source UNION ALL SELECT 'part', count(*), 0.8 FROM part")
def corpus_union(t):
    both = corpus(t).select("text", "category", "source", "confidence").unionByName(parts(t).select("text", F.lit("part").alias("category"), F.lit("part").alias("source"), F.lit(0.8).alias("confidence")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _fill_sql(templates: list[str], key: list[str], category: str) -> str:
    text = f"{lit(templates)}[template + 1]"
    text = f"replace({text}, '{{category}}', {category})"
    for s, own in C.SLOTS.items():
        text = f"replace({text}, '{{{s}}}', {lit(own)}[1 + {number(*key, repr(s))} % {len(own)}])"
    return text


@query("template_grid", f"WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS category FROM part), g AS (SELECT category, template, draw FROM w, range(0, 5) a(template), range(0, 20) b(draw)) SELECT category, template, draw, {_fill_sql(C.TEMPLATES, [repr('0'), 'category', 'template::VARCHAR', 'draw::VARCHAR'], 'category')} AS text FROM g")
def template_grid(t):
    w = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("category")).distinct()
    return C.template_grid(w)


_M = C.BOUNDARY_ATTRIBUTES["materials"]
_I = number("'0'", "id::VARCHAR", "'first'") + f" % {len(_M)}"
_J = number("'0'", "id::VARCHAR", "'second'") + f" % {len(_M) - 1}"


@query("template_two_distinct", f"WITH p AS (SELECT p_partkey AS id, {_I} AS i, {_J} AS j FROM part) SELECT id, replace(replace('{C.CHAIR_TEMPLATES[3]}', '{{material}}', {lit(_M)}[i + 1]), '{{material2}}', {lit(_M)}[CASE WHEN j >= i THEN j + 2 ELSE j + 1 END]) AS text FROM p")
def template_two_distinct(t):
    d = C.two_distinct(t.part.select(F.col("p_partkey").alias("id")), "id", _M)
    return d.select("id", C.fill(F.lit(C.CHAIR_TEMPLATES[3]), {"material": F.col("first"), "material2": F.col("second")}).alias("text"))


PROMPTS = ["a photo of a {}.", "a 3d model of a {}.", "a drawing of one {}."]


@query("prompt_grid", f"SELECT n_nationkey AS id, k AS template, replace({lit(PROMPTS)}[k + 1], '{{}}', n_name) AS prompt FROM nation, range(0, 3) r(k)")
def prompt_grid(t):
    p = t.nation.select("n_nationkey", "n_name", F.posexplode(F.array(*map(F.lit, PROMPTS))).alias("k", "template"))
    return p.select(F.col("n_nationkey").alias("id"), F.col("k").cast("long").alias("template"), F.replace("template", F.lit("{}"), F.col("n_name")).alias("prompt"))


FALLBACK = ["modern", "rustic", "baroque"]


@query(
    "prompt_evidence",
    f"""WITH {EDGES}, r AS (SELECT n.dst AS concept, list(DISTINCT e.dst) FILTER (regexp_matches(e.dst, '[13579]$')) AS styles FROM edges n JOIN edges e ON e.src = n.dst WHERE n.src LIKE 'R%' GROUP BY n.dst),
c AS (SELECT concept, unnest(CASE WHEN len(styles) > 0 THEN styles ELSE {lit(FALLBACK)} END) AS term FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY md5('0:' || term), term) AS n FROM c)
SELECT concept, string_agg(term, ', ' ORDER BY n) AS styles FROM k WHERE n <= 3 GROUP BY concept""",
)
def prompt_evidence(t):
    e = edges(t)
    own = e.where("src like 'R%'").select(F.col("dst").alias("src")).join(e.select("src", "dst"), "src").groupBy("src").agg(F.collect_set("dst").alias("related"))
    kept = F.filter("related", lambda x: x.rlike("[13579]$"))
    drawn = F.transform(F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, FALLBACK))), lambda x: F.struct(F.md5(F.concat(F.lit("0:"), x)).alias("h"), x.alias("x")))
    return own.select(F.col("src").alias("concept"), F.array_join(F.transform(F.slice(F.array_sort(drawn), 1, 3), lambda s: s["x"]), ", ").alias("styles"))


EVIDENCE = ["the", "and", "de", "que", "la", "der", "die", "art deco"]
HITS = " + ".join(f"({term_match('text', repr(x))})::INTEGER" for x in EVIDENCE)


def _hits(text: str):
    """How many phrases stand between word boundaries: a text's words are made once for all that are one word."""
    low = F.lower(F.col(text))
    one = [x for x in EVIDENCE if " " not in x]
    out = F.size(F.array_intersect(F.array(*map(F.lit, one)), F.split(low, "[^A-Za-z0-9_]+")))
    for x in EVIDENCE:
        if x not in one:
            out = out + (low.contains(x) & X.has_term(F.col(text), F.lit(x))).cast("int")
    return F.when(F.col(text).isNotNull(), out)


@query("evidence_guard", f"SELECT doc_id, {HITS} >= 2 AS accepted FROM documents")
def evidence_guard(t):
    return t.documents.select("doc_id", (_hits("text") >= 2).alias("accepted"))


@query("accept_cap6", f"WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE {HITS} >= 2) SELECT doc_id, source FROM a WHERE n <= 6")
def accept_cap6(t):
    a = t.documents.select("doc_id", "source", _hits("text").alias("hits")).where("hits >= 2")
    w = Window.partitionBy("source").orderBy("doc_id")
    return a.withColumn("n", F.row_number().over(w)).where("n <= 6").select("doc_id", "source")


CACHE = "cache AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS term, CASE WHEN length(split_part(text, ' ', 1)) % 4 = 0 THEN '' ELSE upper(split_part(text, ' ', 1)) END AS value FROM benchmark), wanted AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS term FROM documents WHERE length(text) > 0)"


def upper(c):
    """Letter by letter, as in DuckDB: a letter stays one, so a sharp s gets its own capital and a ligature stays."""
    big = lambda x: F.when(x == "\u00df", "\u1e9e").when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(c, ""), big), "")


def _cache(t):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    cache = t.benchmark.select(F.lower(first).alias("term"), F.when(F.length(first) % 4 == 0, "").otherwise(upper(first)).alias("value")).distinct()
    return t.documents.where("length(text) > 0").select(F.lower(first).alias("term")).distinct(), cache


@query("cache_hits", f"WITH {CACHE} SELECT term, value FROM wanted JOIN cache USING (term) WHERE value <> ''")
def cache_hits(t):
    return C.cache_lookup(*_cache(t), "term")[0].select("term", "value")


@query("cache_misses", f"WITH {CACHE} SELECT term FROM wanted WHERE term NOT IN (SELECT term FROM cache)")
def cache_misses(t):
    return C.cache_lookup(*_cache(t), "term")[1]


@query("join_anti_cache", f"WITH {CACHE} SELECT left(term, 1) AS letter, count(*) AS n FROM wanted WHERE term NOT IN (SELECT term FROM cache) GROUP BY 1")
def join_anti_cache(t):
    return C.cache_lookup(*_cache(t), "term")[1].groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


BOTH = f"{PARTS}, texts AS (SELECT doc_id, text FROM parts UNION ALL SELECT doc_id + 1000000000, text FROM documents)"


def _both(t):
    return parts(t).union(t.documents.select(F.col("doc_id") + 1000000000, "text"))


@query("attrs_substring", f"WITH {BOTH}, {terms_sql(C.ATTRIBUTES)} SELECT doc_id, type, string_agg(term, ',' ORDER BY term) AS found FROM texts JOIN terms ON contains(lower(text), term) GROUP BY doc_id, type")
def attrs_substring(t):
    return C.attributes(_both(t), C.ATTRIBUTES).select("doc_id", "type", F.array_join("values", ",").alias("found"))


@query("attrs_boundary", f"WITH {BOTH}, {terms_sql(C.BOUNDARY_ATTRIBUTES)} SELECT doc_id, type, string_agg(term, ',' ORDER BY term) AS found FROM texts JOIN terms ON {term_match('text', 'term', True)} GROUP BY doc_id, type")
def attrs_boundary(t):
    return C.attributes(_both(t), C.BOUNDARY_ATTRIBUTES, boundary=True).select("doc_id", "type", F.array_join("values", ",").alias("found"))


@query("join_theta_vocab", f"WITH {PARTS}, {terms_sql(C.ATTRIBUTES)} SELECT term, type, count(*) AS n FROM parts JOIN terms ON contains(text, term) GROUP BY term, type")
def join_theta_vocab(t):
    v = F.broadcast(C.terms(t.spark, C.ATTRIBUTES).distinct())
    return parts(t).join(v, F.col("text").contains(F.col("term"))).groupBy("term", "type").agg(F.count(F.lit(1)).alias("n"))


_TERMS = [(k, x) for k, own in C.ATTRIBUTES.items() for x in sorted(set(own))]
N_ATTRIBUTES = "(" + " + ".join(f"contains(lower(text), '{x}')::INTEGER" for _, x in _TERMS) + ")"
SCORE = f"greatest(0.0, least(1.0, confidence + least(0.05 * {N_ATTRIBUTES}, 0.2) + CASE WHEN len({words('text')}) BETWEEN 15 AND 50 THEN 0.1 WHEN len({words('text')}) < 8 THEN -0.2 ELSE 0.0 END - CASE WHEN source = 'synthetic' THEN 0.1 ELSE 0.0 END))"


@query("quality_score", f"WITH {CORPUS} SELECT doc_id, {N_ATTRIBUTES}::BIGINT AS n_attributes, round(({SCORE})::DOUBLE, 6) AS score FROM corpus")
def quality_score(t):
    return C.scored(corpus(t)).select("doc_id", "n_attributes", F.round("score", 6).alias("score"))


@query("quality_filter", f"WITH {CORPUS}, s AS (SELECT *, round(({SCORE})::DOUBLE, 6) AS score FROM corpus) SELECT doc_id, score AS confidence FROM s WHERE score >= 0.5")
def quality_filter(t):
    s = C.scored(corpus(t)).withColumn("confidence", F.round("score", 6))
    return s.where("confidence >= 0.5").select("doc_id", "confidence")


BUILD = f"""{CORPUS}, clean AS (SELECT doc_id, {nws('text')} AS text, category, source, confidence FROM corpus),
kept AS (SELECT * FROM clean WHERE {ROW_FILTER}),
best AS (SELECT *, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY confidence DESC, doc_id) AS n FROM kept),
built AS (SELECT doc_id, text, category, source, {N_ATTRIBUTES}::BIGINT AS n_attributes, ({SCORE})::DOUBLE AS confidence FROM best WHERE n = 1)"""


@query("corpus_build", f"WITH {BUILD} SELECT category, count(*) AS n, sum(n_attributes)::BIGINT AS n_attributes, round(avg(confidence), 6) AS confidence FROM built WHERE confidence >= 0.5 GROUP BY category")
def corpus_build(t):
    b = C.build_corpus(corpus(t), categories())
    return b.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("n_attributes").alias("n_attributes"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("corpus_build_semantic")
def corpus_build_semantic(t):
    """The whole build with semantic deduplication over all corpus rows."""
    return C.build_corpus(corpus(t), categories(), similar=0.85).select("doc_id", "category", "source", "n_attributes", F.round("confidence", 6).alias("confidence"))


#: Documents 2k and 2k + 1 have the stored vector k, if there is one.
STORED = """vec AS (SELECT doc_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON vec_id = doc_id // 2),
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec WHERE id IN (SELECT doc_id FROM best WHERE n = 1)),
near AS (SELECT a.id AS i, b.id AS j, b.id AS place FROM u a JOIN u b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 9) > 0.3)"""


@query(
    "corpus_build_vectors",
    f"""WITH RECURSIVE {BUILD}, {STORED}, {turns("SELECT doc_id AS id, confidence FROM best WHERE n = 1")}, stay AS (SELECT id FROM conf WHERE id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM going ORDER BY n DESC LIMIT 1)))
SELECT doc_id, category, source, n_attributes, round(confidence, 6) AS confidence FROM built WHERE confidence >= 0.5 AND doc_id IN (SELECT id FROM stay)""",
)
def corpus_build_vectors(t):
    """The whole build with semantic deduplication by stored vectors, over all corpus rows."""
    stored = t.documents.select("doc_id", F.floor(F.col("doc_id") / 2).alias("vec_id")).join(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    b = C.build_corpus(corpus(t), categories(), similar=0.3, above=0, vectors=stored.select("doc_id", "v"))
    return b.select("doc_id", "category", "source", "n_attributes", F.round("confidence", 6).alias("confidence"))


@query("dist_category", "SELECT lang AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6)::DOUBLE AS percent FROM documents GROUP BY lang")
def dist_category(t):
    return C.share(t.documents.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("n"), "category")


@query("dist_source", "SELECT source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6)::DOUBLE AS percent FROM documents GROUP BY source")
def dist_source(t):
    return C.share(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("n"), "source")


@query("top_attrs", f"WITH {PARTS}, {terms_sql(C.ATTRIBUTES)}, c AS (SELECT type, term AS value, count(*) AS n FROM parts JOIN terms ON contains(text, term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def top_attrs(t):
    found = C.attributes(parts(t), C.ATTRIBUTES).select("type", F.explode("values").alias("value"))
    return C.top_values(found.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n")), "type", "value")


@query("corpus_meta", f"WITH {CORPUS} SELECT count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(avg(confidence), 6) AS confidence FROM corpus")
def corpus_meta(t):
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return corpus(t).agg(F.count(F.lit(1)).alias("n"), names("category").alias("categories"), names("source").alias("sources"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("coverage_share", f"SELECT lang, round(avg(({HITS} >= 2)::INTEGER), 6) AS share FROM documents GROUP BY lang")
def coverage_share(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg((_hits("text") >= 2).cast("int")), 6).alias("share"))


COVERAGE = f"{terms_sql(C.ATTRIBUTES)}, c AS (SELECT type AS field, term, count(*) AS n FROM documents JOIN terms ON contains(lower(text), term) GROUP BY ALL)"


def _coverage(t):
    found = C.attributes(t.documents.select("doc_id", "text"), C.ATTRIBUTES).select(F.col("type").alias("field"), F.explode("values").alias("term"))
    return found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_top10", f"WITH {COVERAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def coverage_top10(t):
    return C.top_values(_coverage(t), "field", "term")


@query("field_entropy", f"WITH {COVERAGE}, p AS (SELECT field, n / sum(n) OVER (PARTITION BY field) AS p FROM c) SELECT field, round(-sum(p * ln(p + 1e-12)), 6) AS entropy FROM p GROUP BY field")
def field_entropy(t):
    p = _coverage(t).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("field")))
    return p.groupBy("field").agg(F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-12)), 6).alias("entropy"))


@query("cloud_size_stats", "WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(median(n), 6)::DOUBLE AS median, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM s")
def cloud_size_stats(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.round(F.expr("percentile(n, 0.5)"), 6).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


@query("max_group", f"WITH {EDGES}, s AS (SELECT src, count(*) AS n FROM edges GROUP BY src) SELECT src AS graph_id, n FROM s ORDER BY n DESC, src LIMIT 1")
def max_group(t):
    s = edges(t).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("src").alias("src"))).alias("b")
    return s.agg(best).select(F.col("b.src").alias("graph_id"), (-F.col("b.m")).alias("n"))


@query("weighted_meter", "SELECT event_type AS meter, round(sum(value * (1 + user_id % 7)) / sum(1 + user_id % 7), 6) AS mean, sum(1 + user_id % 7)::BIGINT AS n FROM events GROUP BY event_type")
def weighted_meter(t):
    n = 1 + F.col("user_id") % 7
    return t.events.groupBy(F.col("event_type").alias("meter")).agg(F.round(F.sum(F.col("value") * n) / F.sum(n), 6).alias("mean"), F.sum(n).alias("n"))


@query("dedup_exact", "SELECT DISTINCT trim(text) AS text FROM documents")
def dedup_exact(t):
    return t.documents.select(F.trim("text").alias("text")).distinct()


@query("dedup_keep_best", f"WITH {CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY md5(lower({nws('text')})) ORDER BY confidence DESC, doc_id) AS n FROM corpus) SELECT doc_id, confidence FROM r WHERE n = 1")
def dedup_keep_best(t):
    return D.keep_best(corpus(t)).select("doc_id", "confidence")


@query("dedup_model_first", f"WITH {RETR} SELECT d_label AS model, min(d) AS first FROM d GROUP BY d_label")
def dedup_model_first(t):
    d = queries_and_items(t)[1]
    return D.first_by(d.select(F.col("d_label").alias("model"), "d", F.col("d").alias("pos")), "model", "pos").select("model", F.col("d").alias("first"))


@query("closure", f"WITH RECURSIVE {EDGES}, c(node) AS (SELECT dst FROM edges WHERE src = 'R1' AND rel = 'has' UNION SELECT dst FROM edges JOIN c ON src = node WHERE rel = 'has') SELECT node FROM c")
def closure(t):
    return G.closure(edges(t).where("src = 'R1'").select(F.col("src").alias("node")), edges(t), "has")


@query(
    "taxonomy_skeleton",
    f"""WITH RECURSIVE {EDGES}, c(node) AS (SELECT dst FROM edges WHERE src IN ('R1', 'R2') AND rel = 'has' UNION SELECT dst FROM edges JOIN c ON src = node WHERE rel = 'has'),
p AS (SELECT DISTINCT dst AS node FROM edges WHERE rel = 'part' AND src IN (SELECT node FROM c UNION SELECT 'R1' UNION SELECT 'R2'))
SELECT DISTINCT lower(node) AS name FROM (SELECT node FROM c UNION ALL SELECT node FROM p) WHERE lower(node) NOT IN ('n1', 'c7', 's2')""",
)
def taxonomy_skeleton(t):
    e = edges(t)
    roots = [e.where(F.col("src") == r).select(F.col("src").alias("node")).distinct() for r in ("R1", "R2")]
    concepts = G.closure(roots[0], e, "has").union(G.closure(roots[1], e, "has")).distinct()
    found = G.closure(concepts.union(roots[0]).union(roots[1]), e, "part")
    names = concepts.union(found).select(X.clean_label(F.col("node")).alias("name")).distinct()
    stop = t.spark.createDataFrame([("n1",), ("c7",), ("s2",)], "name string")
    return names.join(F.broadcast(stop), "name", "left_anti")


FIELDS = {"has": "parts", "part": "materials"}
ATTRS = f"""{EDGES}, e AS (SELECT lower(src) AS s, lower(dst) AS d, CASE rel WHEN 'has' THEN 'parts' ELSE 'materials' END AS field FROM edges),
ends AS (SELECT s AS term, d AS other, field FROM e UNION ALL SELECT d, s, field FROM e WHERE s <> d),
attrs AS (SELECT term, field, string_agg(DISTINCT other, ',' ORDER BY other) AS found, list(DISTINCT other) AS others FROM ends WHERE other NOT IN ('object', 'thing', 'entity') AND length(other) BETWEEN 2 AND 40 AND term LIKE 'n%' GROUP BY ALL)"""


def _attributes(t):
    e = edges(t)
    terms = e.where("rel = 'has' and dst like 'N%'").select(F.lower("dst").alias("term"))
    return G.edge_attributes(e, terms, FIELDS)


@query("edge_attributes", f"WITH {ATTRS} SELECT term, field, found FROM attrs")
def edge_attributes(t):
    return _attributes(t).select("term", "field", F.array_join("values", ",").alias("found"))


@query("semantic_bank", f"WITH {ATTRS} SELECT term AS concept, count(*) AS n_fields, array_to_string(list_sort(list(others) FILTER (field = 'parts')[1])[1:50], ',') AS parts FROM attrs GROUP BY term")
def semantic_bank(t):
    rows = _attributes(t).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("fields"))
    return rows.select(F.col("term").alias("concept"), F.size("fields").cast("long").alias("n_fields"), F.array_join(F.slice(F.col("fields")["parts"], 1, 50), ",").alias("parts"))


GRAPHS = """graph AS (SELECT l_orderkey AS graph_id, l_partkey AS src, l_suppkey AS dst FROM lineitem),
nodes AS (SELECT DISTINCT graph_id, src AS node FROM graph UNION SELECT graph_id, dst FROM graph)"""


def _graphs(t):
    """A graph for each order: an edge from the part to the supplier of each of its lines."""
    e = t.lineitem.select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return e, e.select("graph_id", F.col("src").alias("node")).union(e.select("graph_id", "dst")).distinct()


def _whole_graphs(t):
    """All lineitem rows, ids as they are: a graph for each supplier."""
    e = t.lineitem.select(F.col("l_suppkey").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return e, e.select("graph_id", F.col("src").alias("node")).union(e.select("graph_id", "dst")).distinct()


def _padded(nodes):
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1
    return G.padded_graphs(nodes.select("graph_id", pos.cast("long").alias("pos"), F.col("node").alias("value")))


@query(
    "graph_hops",
    f"""WITH RECURSIVE {GRAPHS}, e AS MATERIALIZED (SELECT graph_id, src, dst, n FROM (SELECT graph_id, src, dst FROM graph UNION SELECT graph_id, dst, src FROM graph) JOIN (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) USING (graph_id)),
w(graph_id, a, b, hops) AS (SELECT graph_id, node, node, 0 FROM nodes UNION SELECT w.graph_id, a, dst, hops + 1 FROM w JOIN e ON w.graph_id = e.graph_id AND b = src WHERE hops + 1 < n),
s AS (SELECT graph_id, a, b, min(hops) AS hops FROM w GROUP BY ALL)
SELECT n.graph_id, n.node AS a, m.node AS b, coalesce(hops, 510)::BIGINT AS hops FROM nodes n JOIN nodes m ON n.graph_id = m.graph_id LEFT JOIN s ON s.graph_id = n.graph_id AND s.a = n.node AND s.b = m.node""",
)
def graph_hops(t):
    return G.hops(_graphs(t)[0])


@query("graph_hops_all")
def graph_hops_all(t):
    """All edges; no SQL, as it would walk all paths.  A row for each node, its hops to all nodes of its graph in the order of their ids."""
    return G.hop_arrays(_whole_graphs(t)[0]).select("graph_id", "node", F.col("pos").cast("long").alias("pos"), "hops")


@query(
    "graph_hop_arrays",
    f"""WITH RECURSIVE {GRAPHS}, e AS MATERIALIZED (SELECT graph_id, src, dst, n FROM (SELECT graph_id, src, dst FROM graph UNION SELECT graph_id, dst, src FROM graph) JOIN (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) USING (graph_id)),
w(graph_id, a, b, hops) AS (SELECT graph_id, node, node, 0 FROM nodes UNION SELECT w.graph_id, a, dst, hops + 1 FROM w JOIN e ON w.graph_id = e.graph_id AND b = src WHERE hops + 1 < n),
s AS (SELECT graph_id, a, b, min(hops) AS hops FROM w GROUP BY ALL)
SELECT n.graph_id, n.node, string_agg(coalesce(hops, 510)::VARCHAR, ',' ORDER BY m.node) AS hops FROM nodes n JOIN nodes m ON n.graph_id = m.graph_id LEFT JOIN s ON s.graph_id = n.graph_id AND s.a = n.node AND s.b = m.node GROUP BY ALL""",
)
def graph_hop_arrays(t):
    """The graph of each order, a row for each node."""
    return G.hop_arrays(_graphs(t)[0]).select("graph_id", "node", F.array_join(F.col("hops").cast("array<string>"), ",").alias("hops"))


@query("feature_offset", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 9 + 1 AS a, l_partkey % 9 + 129 AS b, l_linenumber + 257 AS c, count(*) AS n FROM lineitem GROUP BY ALL")
def feature_offset(t):
    f = G.offset_features(F.array(F.col("l_suppkey") % 9, F.col("l_partkey") % 9, F.col("l_linenumber").cast("long")))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", f.alias("f"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


@query(
    "graph_pad_mask",
    f"""WITH {GRAPHS}, p AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS pos FROM nodes), m AS (SELECT max(pos) AS top FROM p)
SELECT g.graph_id, k AS pos, coalesce(node, 0) AS value, (node IS NOT NULL)::BIGINT AS mask FROM (SELECT DISTINCT graph_id FROM p) g, m, range(0, 100) r(k) LEFT JOIN p ON p.graph_id = g.graph_id AND p.pos = k WHERE k <= top""",
)
def graph_pad_mask(t):
    return _padded(_graphs(t)[1])


@query("graph_pad_mask_all")
def graph_pad_mask_all(t):
    return _padded(_whole_graphs(t)[1])


@query("stoplist_counts", f"WITH {PRED} SELECT truth, count(*) AS n FROM pred WHERE truth <> 'error' GROUP BY truth")
def stoplist_counts(t):
    return pred(t).where("truth <> 'error'").groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


@query("rag_prompt", f"WITH {KB}, r AS (SELECT q, qt, dt, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, d) AS n FROM jac) SELECT q, 'describe: ' || qt || ' context: ' || substr(string_agg(dt, ' ' ORDER BY n), 1, 300) AS prompt FROM r WHERE n <= 3 GROUP BY q, qt")
def rag_prompt(t):
    from ragloom.operators.ranking import nearest_texts

    top = nearest_texts(t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("qt")), t.documents.select(F.col("doc_id").alias("d"), F.col("text").alias("dt")), 3)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dt"))), lambda s: s["dt"])
    p = top.groupBy("q", "qt").agg(F.array_join(texts, " ").alias("context"))
    return p.select("q", F.concat(F.lit("describe: "), "qt", F.lit(" context: "), F.substring("context", 1, 300)).alias("prompt"))
