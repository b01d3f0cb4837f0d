"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a boolean column "this text is bad" over measures of the text.  A
sample tells what each measure costs and which rules fire on which texts; rules
run in the order of rejections per cost, given those before, and a measure is
worked out only for texts that no earlier rule has rejected.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ragloom.session import stash, unstash

#: Java regex of the white space between words.
SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Columns that a cascade adds for a while begin so.
OWN = "_quality_"
#: What quality() returns beside the columns of its input.
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    bad: Column


class Measure(NamedTuple):
    needs: tuple[str, ...]
    value: Callable[[], Column]


def _own(name: str) -> Column:
    return F.col(OWN + name)


def _repeats() -> Column:
    """(hash, position) pairs in order, if any two windows are equal."""
    windows = _own("windows")
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.slice(pairs, 1, 0))


def _repeat_words() -> Column:
    pairs = _own("pairs")
    twins = F.zip_with(pairs, F.slice(pairs, F.lit(2), F.greatest(F.size(pairs), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    covered = F.transform(F.flatten(F.filter(twins, lambda x: x.isNotNull())), lambda i: F.array(i, i + 1, i + 2))
    return F.size(F.array_distinct(F.flatten(covered))).cast("long")


def _windows() -> Column:
    words = _own("words")
    starts = F.slice(words, F.lit(1), F.greatest(_own("n_words").cast("int") - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


#: Measures of the column OWN + "text", each with those that it is made of; a column is built when it is asked for.
#: n_repeat_words looks for equal 3-word windows with a set of their hashes first; only a text that has some goes on to
#: sort (hash, position) pairs.
MEASURES = {
    "words": Measure((), lambda: F.array_remove(F.split(_own("text"), SPACE + "+"), "")),
    "lines": Measure((), lambda: F.filter(F.split(_own("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_words": Measure(("words",), lambda: F.size(_own("words")).cast("long")),
    "windows": Measure(("words", "n_words"), _windows),
    "pairs": Measure(("windows",), _repeats),
    "n_repeat_words": Measure(("pairs",), _repeat_words),
    "word_chars": Measure(("words",), lambda: F.length(F.array_join(_own("words"), "")).cast("long")),
    "n_symbols": Measure((), lambda: F.regexp_count(_own("text"), F.lit(r"[#*$%&|<>]")).cast("long")),
    "n_lines": Measure(("lines",), lambda: F.size(_own("lines"))),
    "n_dup_lines": Measure(("lines",), lambda: (F.size(_own("lines")) - F.size(F.array_distinct(_own("lines")))).cast("long")),
    "bangs": Measure((), lambda: F.regexp_count(_own("text"), F.lit("!"))),
    "capitals": Measure((), lambda: F.regexp_count(_own("text"), F.lit("[A-Z]"))),
    "base_failed": Measure(("n_words", "n_repeat_words"), lambda: (_own("n_words") < MIN_WORDS) | (100 * _own("n_repeat_words") > MAX_REPEAT_PERCENT * _own("n_words"))),
}


def default_rules() -> list[Rule]:
    """Rules over whole numbers, so any engine agrees; the two halves of the base rule are rules of their own."""
    n, chars, of = _own("n_words"), _own("word_chars"), _own
    return [
        Rule("few_words", ("n_words",), n < MIN_WORDS),
        Rule("repeats", ("n_words", "n_repeat_words"), 100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        Rule("symbols", ("n_words", "n_symbols"), 10 * of("n_symbols") > 3 * n),
        Rule("short_words", ("n_words", "word_chars"), chars < 2 * n),
        Rule("long_words", ("n_words", "word_chars"), chars > 20 * n),
        Rule("duplicate_lines", ("n_lines", "n_dup_lines"), 2 * of("n_dup_lines") > of("n_lines")),
        Rule("shouting", ("n_words", "bangs"), 2 * of("bangs") > n),
        Rule("capitals", ("word_chars", "capitals"), 2 * of("capitals") > chars),
    ]


def _with(df: DataFrame, names: Iterable[str], only: Column | None = None) -> DataFrame:
    """Adds measures that df lacks, after those that they are made of; null where ``only`` does not hold."""
    for name in names:
        if OWN + name not in df.columns:
            df = _with(df, MEASURES[name].needs, only)
            value = MEASURES[name].value()
            df = df.withColumn(OWN + name, value if only is None else F.when(only, value))
    return df


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(OWN + "text", F.coalesce(F.col(text), F.lit("")))


def cascade(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds OWN + "rejected", the first rule that fires, or null; a rule and its measures are worked out for what is left.

    The row id at the end, always true, keeps the optimizer from copying the chain of rules into a later
    filter on the verdict, where every use of a verdict would double it.
    """
    rejected = OWN + "rejected"
    df = df.withColumn(rejected, F.lit(None).cast("string"))
    for r in rules:
        left = F.col(rejected).isNull()
        df = _with(df, r.needs, left)
        df = df.withColumn(rejected, F.when(left, F.when(r.bad, F.lit(r.name))).otherwise(F.col(rejected)))
    return df.withColumn(rejected, F.when(F.monotonically_increasing_id() >= 0, F.col(rejected)))


def _needed(needs: Iterable[str]) -> list[str]:
    """Measures and all that they are made of, each after its parts."""
    out: dict[str, None] = {}
    for name in needs:
        out.update(dict.fromkeys([*_needed(MEASURES[name].needs), name]))
    return list(out)


def measure_costs(sample: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Seconds that each measure adds to those of its parts among ``names``, on a frame of OWN + "text"."""

    def run(value: Column, df: DataFrame) -> float:
        asked, began = df.agg(F.sum(value)), time.perf_counter()
        asked.first()
        return time.perf_counter() - began

    took, idle = {}, run(F.octet_length(OWN + "text"), sample)
    for name in names:
        df = _with(sample, [name])
        listed = isinstance(df.schema[OWN + name].dataType, ArrayType)
        took[name] = run(F.size(_own(name)) if listed else _own(name).cast("long"), df)
    return {name: max(took[name] - max((took[x] for x in _needed([name])[:-1] if x in took), default=idle), 0.0) for name in names}


def order_rules(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejections per second on a sample of about ``sample_rows`` raw texts.

    Each measure is timed once, whatever rules share it, and one job tells
    which rules fire on each text of the sample.  The next rule is the one that
    rejects most of the texts that are left, for the cost of the measures that
    no earlier rule has needed.  The order never changes which rows are kept,
    only how soon a bad one is left.  An empty sample leaves the rules as they are.
    """
    total = df.count() if sample_rows else 0
    if not total:
        return list(rules)
    some = df.select(text).sample(fraction=min(1.0, sample_rows / total), seed=11)
    sample = stash(_with_text(some, text).select(OWN + "text").repartition(df.sparkSession.sparkContext.defaultParallelism), "rule-sample")
    needs = {r.name: _needed(r.needs) for r in rules}
    every = _needed(n for r in rules for n in r.needs)
    fired = _with(sample, every).select(*(F.coalesce(r.bad, F.lit(False)).alias(r.name) for r in rules)).collect()
    left = [{r.name for r in rules if x[r.name]} for x in fired]
    # A part that one measure alone is made of is timed with that measure.
    parts = Counter(p for name in every for p in MEASURES[name].needs)
    asked = {n for r in rules for n in r.needs}
    cost = measure_costs(sample, [n for n in every if n in asked or parts[n] > 1])
    unstash(sample)

    waiting, ordered, done = list(rules), [], set()
    while waiting:

        def rate(r: Rule) -> float:
            rejected = sum(r.name in names for names in left)
            return (rejected + 0.5) / (0.001 + sum(cost.get(x, 0.0) for x in needs[r.name] if x not in done))

        best = max(waiting, key=rate)
        waiting.remove(best)
        ordered.append(best)
        done.update(needs[best.name])
        left = [names for names in left if best.name not in names]
    return ordered


def quality(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of df with the base measures, base_failed and kept.

    The base measures are asked for, so they are worked out for every row; the
    cascade saves what further rules need.  Every row comes back once, repeated
    rows too; a null or empty text has zeros and fails the base rule; an empty
    table comes back empty.  Columns of df stay, except that one named like a
    result gives way to it, and names that begin with OWN are not allowed.
    """
    ordered = order_rules(df, list(rules or default_rules()), text, sample_rows)
    taken = [c for c in df.columns if c not in RESULT]
    # Every column travels under its own name only after the text is read, which may have a result's name.
    d = cascade(_with(_with_text(df, text), RESULT[:-1]), ordered)
    return d.select(*(F.col(f"`{c}`") for c in taken), *(_own(c).alias(c) for c in RESULT[:-1]), _own("rejected").isNull().alias("kept"))


def good(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of df that no rule rejects, with all their columns; each measure only for rows still in question.

    Rows with null, empty or repeated texts are judged as quality() judges them.
    """
    ordered = order_rules(df, list(rules or default_rules()), text, sample_rows)
    return cascade(_with_text(df, text), ordered).where(_own("rejected").isNull()).select(*(F.col(f"`{c}`") for c in df.columns))
