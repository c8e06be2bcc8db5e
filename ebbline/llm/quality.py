"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost (seconds over a sample) and selectivity (share of the sample that it rejects) are measured, and rules
run in the order of rejection per cost: a document is judged by the next rule, and its metrics are computed, only if
those before let it pass. The order changes the cost alone; the verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.storage import discard, materialize
from ebbline.llm.text import WORD, let, words

#: Rows of the sample that orders the rules, runs of each rule over it, and the least cost that is told from none.
SAMPLE_ROWS = 2000
RUNS = 2
LEAST_SECONDS = 0.001
SEED = 17
WINDOW = 8


def word_chars(text: Column) -> Column:
    return (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def full_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def line_count(text: Column) -> Column:
    return F.size(full_lines(text)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return let(full_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that the text has twice or more; hashes: one for each word."""

    def of_grams(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, of_placed))

    def of_placed(placed: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(placed, j)["g"] == x["g"], F.lit(False))
        twice = F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda s, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - s, F.lit(window))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) < window, F.lit(0)).otherwise(let(grams, of_grams)).cast("long")


#: Over a text and the hashes of its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, hashes: F.size(hashes).cast("long"),
    "word_chars": lambda text, hashes: word_chars(text),
    "n_symbols": lambda text, hashes: symbols(text),
    "n_lines": lambda text, hashes: line_count(text),
    "n_dup_lines": lambda text, hashes: duplicate_lines(text),
    "n_repeat_words": lambda text, hashes: repeated_words(hashes),
}


@dataclass(frozen=True)
class Rule:
    """rejects(metric) is true for a document to reject; metric(name) gives a column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Limits as whole numbers, so that no rounding decides.
BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (2 * m("word_chars") < 5 * m("n_words")) | (m("word_chars") > 10 * m("n_words"))),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 4 * m("n_lines")),
)
RULES = BASE_RULES + MORE_RULES


def judged(text: Column, use: Callable[[Callable[[str], Column]], Column]) -> Column:
    """use(metric) over one text and the hashes of its words. Both are bound as one variable: no rule of the optimizer puts
    their definition in its place, so a text is cut into words once, wherever a filter on the result is pushed to."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.struct(text.alias("text"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("hashes"))
    return let(parts, lambda x: use(lambda name: METRICS[name](x["text"], x["hashes"])))


def rejected_by(order: Sequence[Rule], metric: Callable[[str], Column]) -> Column:
    """Whether a rule of the order rejects a document. CASE stops at the first that does, and computes the metrics of no later one."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in order:
        verdict = verdict.when(rule.rejects(metric), F.lit(True))
    return verdict.otherwise(F.lit(False))


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> list[tuple[Rule, float, float]]:
    """Rules with cost (seconds over the sample) and selectivity (share of it that the rule rejects), by rejection per cost.

    A rule's cost is the least time of RUNS jobs after a first one that compiles it, less that of a job that only reads
    the sample's words. Equal ratios stand in the order given.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).sample(min(1.0, sample_rows / total), seed)
    sample = materialize(texts.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))), "sample")
    metric = lambda name: METRICS[name](F.col("text"), F.col("hashes"))

    def timed(rejects: Column) -> tuple[float, float]:
        times, share = [], 0.0
        for _ in range(RUNS + 1):
            began = time.monotonic()
            share = sample.agg(F.avg(rejects.cast("int")), F.sum(F.size("hashes"))).first()[0] or 0.0
            times.append(time.monotonic() - began)
        return min(times[1:]), share

    idle, _ = timed(F.lit(False))
    measured = []
    for rule in rules:
        seconds, share = timed(rule.rejects(metric))
        measured.append((rule, max(seconds - idle, LEAST_SECONDS), share))
    discard(sample)
    return sorted(measured, key=lambda x: -x[2] / x[1])


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that no rule rejects, with their own columns. A null or empty text has no words and is rejected by
    few_words. Repeated rows are judged each."""
    order = [r for r, _, _ in measured_order(docs, rules)]
    return docs.filter(~judged(F.col("text"), lambda metric: rejected_by(order, metric)))


#: What a report shows of every document.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the metrics SHOWN, and kept: the cascade's verdict, in the measured order. The metrics
    shown are computed once and bound; the cascade computes others only where it gets to them. Nulls and repeated rows as in
    quality_filter; other columns are ignored."""
    order = [r for r, _, _ in measured_order(docs, rules)]

    def shown(metric: Callable[[str], Column]) -> Column:
        either = lambda x: lambda name: x[name] if name in SHOWN else metric(name)
        verdict = lambda x: F.struct(*[x[n].alias(n) for n in SHOWN], (~rejected_by(order, either(x))).alias("kept"))
        return let(F.struct(*[metric(n).alias(n) for n in SHOWN]), verdict)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), shown).alias("report")).select("doc_id", "report.*")
