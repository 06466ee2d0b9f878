"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row of ``RULES``: a metric, the least and the greatest value
that passes.  :func:`quality_report` computes the metrics with built-in
functions only (no user functions, no shuffle, no join: the whole operator is
one map over the scan) and compiles the table into one Boolean column.

Words are maximal runs without ASCII white space; lines are the ``\\n``-split
parts.  Repeated words are found in the row itself: the sorted
(3-word window, position) pairs put equal windows side by side, so the cost is
n log n in the text's length and no position is exploded.

Defined results: null and empty texts have no words and fail; repeated rows
each get their own result; other columns of the input pass through
:func:`filter_documents` untouched, whatever their names (metrics live in one
struct column with a unique name); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.common import WS, own

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on with as are be by this at from or an "
    "der die und den von das zu sich mit für nicht des auf ist im dem ein eine als auch "
    "de la le et les en un du une que pour est dans qui par au sur pas avec ne "
    "el las y los se del por con para no su al es lo una como más"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A metric passes when ``low <= metric <= high`` (None: no bound)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: length, symbol, stop-word and line thresholds; metrics are those of metric_columns().
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=3.0, high=10.0),
    Rule("symbols_per_word", high=0.1),
    Rule("exclamations_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.06),
    Rule("dup_line_ratio", high=0.5),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compile_rules(rules=RULES, metric=F.col) -> Column:
    """The threshold table as one Boolean column; ``metric`` maps a name to its column."""
    passed = F.lit(True)
    for r in rules:
        if r.low is not None:
            passed = passed & (metric(r.metric) >= F.lit(r.low))
        if r.high is not None:
            passed = passed & (metric(r.metric) <= F.lit(r.high))
    return passed


def _windows(words: Column) -> Column:
    # words hold no blank, so joining by blanks keeps windows apart
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.slice(words, F.lit(1), F.size(words) - 2),
            lambda x, i: F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _metric_struct(words: str, lines: str, text: str, covered: str) -> Column:
    w, ln, t = F.col(words), F.col(lines), F.col(text)
    n = F.size(w).cast("long")
    least1 = F.greatest(n, F.lit(1))
    word_chars = F.length(F.array_join(w, "")).cast("long")
    n_symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    exclamations = F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))
    dup_lines = (F.size(ln) - F.size(F.array_distinct(ln))).cast("long")
    stops = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
    return F.struct(
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        n_symbols.alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
        F.col(covered).cast("long").alias("n_repeat_words"),
        (word_chars / least1).alias("mean_word_chars"),
        (n_symbols / least1).alias("symbols_per_word"),
        (exclamations / least1).alias("exclamations_per_word"),
        (stops / least1).alias("stop_word_ratio"),
        (dup_lines / F.greatest(F.size(ln), F.lit(1))).alias("dup_line_ratio"),
    )


def with_metrics(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``into`` that holds every metric of a text."""
    t, words, lines, win, srt, cov = (own(x) for x in ("text", "words", "lines", "win", "sorted", "cov"))
    split = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    split = split.withColumns(
        {
            words: F.array_remove(F.split(t, f"[{WS}]+"), ""),
            lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]")),
        }
    ).withColumn(win, _windows(F.col(words)))
    # equal windows side by side; only texts that repeat a window are sorted
    repeats = F.size(win) > F.size(F.array_distinct(win))
    split = split.withColumn(
        srt,
        F.when(
            repeats,
            F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("k"), i.alias("i")))),
        ),
    )
    s = F.col(srt)
    starts = F.sort_array(
        F.transform(
            F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("prev"), (a["n"] + F.least(F.lit(3), p - a["prev"])).alias("n")),
        lambda a: a["n"],
    )
    split = split.withColumn(cov, F.coalesce(covered, F.lit(0)))
    once = own("once")
    split = split.withColumn(once, _metric_struct(words, lines, t, cov))
    # a caller's filter on a metric would be pushed down and repeat its expressions element by element;
    # nothing is pushed through a generator, so metrics are computed once
    return split.withColumn(into, F.explode(F.array(once))).drop(t, words, lines, win, srt, cov, once)


def base_failed(metric=F.col) -> Column:
    n = metric("n_words")
    return (n < MIN_WORDS) | (100 * metric("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def quality_report(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the metrics, ``base_failed`` and ``kept``."""
    m = own("m")
    scored = with_metrics(docs.select(F.col(id_col), F.col(text)), m, text).select(id_col, f"{m}.*")
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & compile_rules(rules)
    )


def filter_documents(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with exactly the columns they came with."""
    m = own("m")
    of = lambda name: F.col(f"{m}.{name}")
    return with_metrics(docs, m, text).where(~base_failed(of) & compile_rules(rules, of)).drop(m)
