"""Main text of web pages by a tree-structured graphical model.

Each element that can hold a block is a node with two states, content and
boilerplate.  A node's potential comes from what the page says of it (tag, words
in class and id, length of its own text, share of link text, punctuation); an
edge's potential ties a node to its parent.  Sum-product messages run from the
leaves up and from the root down, which gives every node's exact marginal.  All
potentials are counts over labelled pages, gathered by Spark.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.arrays import batch, tidy
from ragloom.session import text_batches

#: Fixed values of HTML: elements without content, with raw text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph when they start.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open element of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html".split())
#: Elements with a feature of their own; all others share one, so there are fewer than 200 features whatever the pages.
NAMED = INLINE | ENDS_P | SCOPES | SIBLINGS.keys() | frozenset("#root head button caption center dialog figcaption label legend optgroup output search summary tbody tfoot thead".split())

#: Words in tag, class, id or role that speak for boilerplate or for content.
BOILERPLATE = frozenset(
    "nav navbar navigation menu header footer foot masthead aside sidebar ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay form search login signup subscribe newsletter share sharing social comment comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer button select dialog".split()
)
#: Words of BOILERPLATE that name a control or a topic; inside a longer name they say nothing of a part that reads as prose.
DOUBTFUL = frozenset("button form search select share sharing social".split())
CONTENT = frozenset("article main content story entry post body text blogpost articlebody prose".split())

#: A quote opens a value only behind an equals sign, and only if it is closed; a tag that the page does not end runs to its end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page(NamedTuple):
    """Nodes of a page in document order, and its runs of text as (node, block, text)."""

    tags: list[str]
    hints: list[int]
    parents: list[int]
    links: list[int]
    runs: list[tuple[int, int, str]]


#: What _hint() returns where only the text can tell.
DOUBT = 2


def _hint(tag: str, attributes: str) -> int:
    """-1 boilerplate, 1 content, 0 neither; boilerplate wins.

    DOUBT if all that speaks for boilerplate are doubtful words of longer names, as in "social-history".
    """
    names, doubt = {tag} - {"body"}, False
    if "=" in attributes:
        for m in _HINTS.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                words = set(_PIECES.findall(_CAMEL.sub(" ", name).lower()))
                if words & DOUBTFUL and words & BOILERPLATE <= DOUBTFUL and words - BOILERPLATE:
                    doubt = True
                else:
                    names |= words
    if names & BOILERPLATE:
        return -1
    return DOUBT if doubt else int(bool(names & CONTENT))


#: A part reads as prose from so many characters, with an end of a sentence in every 200 and at most a quarter of them in links.
PROSE = 40


def _settle(p: Page) -> None:
    """Doubtful hints become none where the part reads as prose, and boilerplate elsewhere."""
    if DOUBT not in p.hints:
        return
    size, ends, links = [0] * len(p.tags), [0] * len(p.tags), list(p.links)
    for node, _, t in p.runs:
        size[node] += len(t)
        ends[node] += sum(map(t.count, ".!?"))
    for i in range(len(p.tags) - 1, 0, -1):
        if p.hints[i] == DOUBT:
            p.hints[i] = 0 if size[i] >= PROSE and 200 * ends[i] >= size[i] and 4 * links[i] <= size[i] else -1
        for sums in (size, ends, links):
            sums[p.parents[i]] += sums[i]


def parse(page: str) -> Page:
    """A forgiving reader: paragraphs, list items and cells end where the next begins; stray end tags are dropped.

    A text run belongs to the innermost node; line elements are nodes only if
    their class or id hints at something.  Two runs share a block if no node
    begins or ends between them.  The head and raw elements give no text.
    """
    tags, hints, parents, links, runs = ["#root"], [0], [-1], [0], []
    stack: list[tuple[str, int]] = [("#root", 0)]
    block, at, n = 0, 0, len(page)
    open_links = 0
    in_head = 0
    opened: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw and not in_head and not raw.isspace():
            node = stack[-1][1]
            runs.append((node, block, html.unescape(raw)))
            if open_links:
                links[node] += len(raw)
        elif raw and runs and runs[-1][1] == block:
            runs.append((runs[-1][0], block, " "))

    def close(tag: str) -> bool:
        """Pop up to and including the innermost tag; true if a node ended."""
        nonlocal open_links, in_head
        ended = False
        while len(stack) > 1:
            name, node = stack.pop()
            opened[name] -= 1
            open_links -= name == "a"
            in_head -= name == "head"
            ended |= node != stack[-1][1]
            if name == tag:
                break
        return ended

    def has(names: frozenset | set, until: frozenset = frozenset()) -> str | None:
        # Most often nothing of the kind is open, which a deep page should not have to search for.
        if not any(opened[x] for x in names):
            return None
        for name, _ in reversed(stack):
            if name in names:
                return name
            if name in until:
                return None
        return None

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if has({tag}):
                block += close(tag)
            elif tag == "p":
                block += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr" or tag in VOID:
            if tag == "hr":
                block += 1
            elif runs and runs[-1][1] == block:
                runs.append((runs[-1][0], block, " "))
            continue
        if tag in ENDS_P and has({"p"}, frozenset({"table", "button"})):
            block += close("p")
        if tag in SIBLINGS and (open_one := has(SIBLINGS[tag], SCOPES)):
            block += close(open_one)
            while tag == "tr" and (open_one := has({"tr"}, SCOPES)):
                block += close(open_one)
        if tag == "body" and has({"head"}):
            close("head")
        hint = _hint(tag, m[3])
        if m[3].rstrip().endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        node = stack[-1][1]
        if tag not in INLINE or hint:
            parents.append(node)
            tags.append(tag)
            hints.append(hint)
            links.append(0)
            node = len(tags) - 1
            block += tag not in INLINE
        stack.append((tag, node))
        opened[tag] += 1
        open_links += tag == "a"
        in_head += tag == "head"
    p = Page(tags, hints, parents, links, runs)
    _settle(p)
    return p


def node_features(p: Page) -> list[tuple[str, ...]]:
    """Names of what is seen at each node."""
    size, marks = [0] * len(p.tags), [0] * len(p.tags)
    for node, _, t in p.runs:
        size[node] += len(t)
        marks[node] += sum(map(t.count, ".,;:!?"))
    out = []
    for i, tag in enumerate(p.tags):
        seen = [f"hint {p.hints[i]}", "tag hinted" if p.hints[i] else f"tag {tag}" if tag in NAMED else "tag other"]
        if size[i]:
            seen.append(f"length {min(size[i].bit_length(), 10)}")
            seen.append(f"links {min(4, 4 * p.links[i] // size[i])}")
            seen.append(f"marks {min(3, 200 * marks[i] // size[i])}")
        out.append(tuple(seen))
    return out


def semantic_labels(p: Page) -> list[int | None]:
    """Labels that a page with an article element gives itself: inside it content, outside and in hinted parts boilerplate.

    The root, html and body hold both and have no label; a page without an
    article or main element has none at all.
    """
    if not {"article", "main"} & set(p.tags):
        return [None] * len(p.tags)
    out: list[int | None] = []
    for i, tag in enumerate(p.tags):
        above = out[p.parents[i]] if i else None
        if tag in ("#root", "html", "body"):
            out.append(None)
        elif p.hints[i] < 0 or above == 0 and p.tags[p.parents[i]] not in ("html", "body", "#root") and p.hints[p.parents[i]] < 0:
            out.append(0)
        elif tag in ("article", "main") or above == 1:
            out.append(1)
        else:
            out.append(0)
    return out


def label_counts(page: str, labels=semantic_labels) -> Counter[tuple[str, int]]:
    """Counts that one labelled page adds: features, nodes and edges by label."""
    p = parse(page)
    own = labels(p)
    seen: Counter[tuple[str, int]] = Counter()
    for i, names in enumerate(node_features(p)):
        if own[i] is None:
            continue
        seen.update((x, own[i]) for x in names)
        seen["#all", own[i]] += 1
        if i and own[p.parents[i]] is not None:
            seen[f"#edge {p.hints[p.parents[i]]} {own[p.parents[i]]}", own[i]] += 1
    return seen


class Model(NamedTuple):
    """Log potentials of each feature (boilerplate, content), and potentials of the parent's hint, its state and the child's."""

    node: dict[str, tuple[float, float]]
    edge: np.ndarray


#: Weight of what the hints mean before any page is seen.
PRIOR = 20.0
#: Share of each row that an edge to the other state has at least, unless the parent is hinted boilerplate.
CHANGE = 0.01
#: What is seen of a node's text is not independent, so it counts for a quarter.
TEXT_WEIGHT = 0.25


def fit(table: Counter) -> Model:
    """Potentials from counts of (feature, label) and ("#edge <parent hint> <parent label>", label)."""
    table = Counter(table)
    for name, label in (("hint -1", 0), ("hint 1", 1), ("#edge -1 0", 0), ("#edge 0 0", 0), ("#edge 0 1", 1), ("#edge 1 1", 1)):
        table[name, label] += PRIOR
        if name[0] != "#":
            table["#all", label] += PRIOR
    total = [table["#all", k] + 2.0 for k in (0, 1)]
    names = {k[0] for k in table if not k[0].startswith("#")} | {"hint 0"}
    weight = {x: 1.0 if x.startswith("hint") else TEXT_WEIGHT for x in names}
    node = {x: tuple(weight[x] * float(np.log((table[x, k] + 1.0) / total[k])) for k in (0, 1)) for x in sorted(names)}
    edge = np.array([[[table[f"#edge {h} {a}", b] + 1.0 for b in (0, 1)] for a in (0, 1)] for h in (-1, 0, 1)])
    edge[1:] += CHANGE * edge[1:].sum(axis=2, keepdims=True)
    return Model(node, edge / edge.sum(axis=2, keepdims=True))


def train(pages: DataFrame, column: str = "html", labels=semantic_labels) -> Model:
    """Count features by label, and labels by parent label, over all labelled pages.

    ``labels`` gives a parsed page's labels, None where unknown.  All pages and
    all features count; what tasks return is bounded by the number of features.
    """
    schema = pa.schema([("name", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(label_counts(t.as_py() or "", labels))
        keys = list(seen)
        yield batch(schema, [k[0] for k in keys], [k[1] for k in keys], [seen[k] for k in keys])

    rows = pages.select(column).mapInArrow(tidy(count), "name string, label int, n long").groupBy("name", "label").agg(F.sum("n").alias("n"))
    return fit(Counter({(r["name"], r["label"]): r["n"] for r in rows.collect()}))


def marginals(p: Page, m: Model) -> list[float]:
    """Probability that each node is content, by sum-product on the tree."""
    n = len(p.tags)
    tables = m.edge.tolist()
    phi = []
    for names in node_features(p):
        a = b = 0.0
        for x in names:
            low, high = m.node.get(x, (0.0, 0.0))
            a += low
            b += high
        top = max(a, b)
        phi.append((np.exp(a - top).item(), np.exp(b - top).item()))
    belief = [list(x) for x in phi]
    up = [(1.0, 1.0)] * n
    # Children come after their parents, so one pass backwards sends all messages up.
    for i in range(n - 1, 0, -1):
        b0, b1 = belief[i]
        e = tables[p.hints[p.parents[i]] + 1]
        u0, u1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
        s = u0 + u1
        up[i] = (u0 / s, u1 / s)
        parent = belief[p.parents[i]]
        parent[0] *= up[i][0]
        parent[1] *= up[i][1]
        s = parent[0] + parent[1]
        parent[0] /= s
        parent[1] /= s
    out = [0.0] * n
    full = [(0.5, 0.5)] * n
    for i in range(n):
        b0, b1 = belief[i]
        if i:
            f0, f1 = full[p.parents[i]]
            e = tables[p.hints[p.parents[i]] + 1]
            # The parent's belief without what this node told it.
            d0, d1 = f0 / max(up[i][0], 1e-300), f1 / max(up[i][1], 1e-300)
            b0 *= d0 * e[0][0] + d1 * e[1][0]
            b1 *= d0 * e[0][1] + d1 * e[1][1]
        s = b0 + b1
        full[i] = (b0 / s, b1 / s)
        out[i] = b1 / s
    return out


def main_text(page: str, m: Model) -> str:
    """Blocks of content in page order, joined by an empty line; white space inside a block is one blank."""
    p = parse(page)
    keep = marginals(p, m)
    blocks: dict[int, list[str]] = {}
    for node, block, t in p.runs:
        if keep[node] >= 0.5:
            blocks.setdefault(block, []).append(t)
    joined = (" ".join("".join(own).split()) for own in blocks.values())
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame, model: Model | None = None, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row; null and empty pages give an empty text.

    Without a model, one is trained on the pages themselves, as far as they
    label themselves.  Repeated rows stay; other columns are not carried.
    """
    text_batches(pages.sparkSession)
    model = model or train(pages, column)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [main_text(t.as_py() or "", m) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, column).mapInArrow(tidy(run), f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
