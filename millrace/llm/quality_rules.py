"""Quality rules: a threshold table compiled into one projection, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import WORD_SPACE, WORD_SPACE_CLASS, common_words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """value(measures) must lie in [low, high]; None leaves a side open."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The table that ships: SQL over the measures below, and the bounds a kept text obeys.
DEFAULT_RULES = (
    Rule("length", "n_words", 50, 200_000),
    Rule("mean_word_length", "word_chars / n_words", 2, 14),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.5),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WORD_SPACE)) != "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words to docs.

    A null text has no words. Repeated windows are found by sorting 64-bit codes of the text's
    own 3-word windows, so nothing is shuffled and the work is n log n in the words of one text.
    """
    docs = docs.drop(*MEASURES, "_words", "_lines", "_sorted", "_same")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(WORD_SPACE))
    stop = F.array(*map(F.lit, common_words()))
    d = docs.withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE_CLASS + "+"))
    )
    d = d.withColumn("_lines", _lines(whole))
    n = F.size("_words")
    pairs = F.zip_with("_words", F.slice("_words", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("_words", 3, F.greatest(n, F.lit(1))), lambda ab, c: F.xxhash64(ab, c))
    windows = F.slice(triples, 1, F.greatest(n - 2, F.lit(0)))
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", ordered)
    after = F.slice("_sorted", 2, F.greatest(n, F.lit(1)))
    d = d.withColumn("_same", F.zip_with("_sorted", after, lambda a, b: F.coalesce(a.h == b.h, F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.col("_same"))
    marked = F.zip_with(
        F.zip_with("_sorted", F.col("_same"), lambda s, e: F.struct(s.i.alias("i"), e.alias("e"))),
        before,
        lambda s, e: F.when(s.e | e, s.i),
    )
    places = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a.n + i + 3 - F.greatest(i, a.to)).cast("long").alias("n"), (i + 3).alias("to")),
        lambda a: a.n,
    )
    stops = F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(w))))
    out = d.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        stops.cast("long").alias("n_stop_words"),
    )
    return out


def compile_rules(rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """One Boolean: every rule holds. A ratio without a denominator holds no rule back."""
    kept = F.lit(True)
    for rule in rules:
        value = F.expr(f"try_divide({', '.join(rule.value.split(' / '))})" if " / " in rule.value else rule.value)
        if rule.low is not None:
            kept &= F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            kept &= F.coalesce(value <= rule.high, F.lit(True))
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The measures of every row with base_failed and kept. Columns of docs with a measure's name give way to it.

    Null and empty texts have no words and fail the base; repeated rows are judged each; an empty table
    gives an empty one; other columns pass through.
    """
    d = measures(docs.drop("base_failed", "kept"))
    return d.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & compile_rules(rules)})
