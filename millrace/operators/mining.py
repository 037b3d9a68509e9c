"""Dictionaries mined from linked pairs: counts and shares over exploded tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.grouping import best_in_group


def vocabulary(texts: DataFrame, tokens: str, least: int = 3) -> DataFrame:
    """(token, n) of alphabetic tokens that occur `least` times or more."""
    words = texts.select(F.explode(tokens).alias("token")).filter(F.col("token").rlike("^[a-z]+$"))
    return words.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def alignments(pairs: DataFrame, left: str, right: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """(word, to, n, share): pairs of texts with as many tokens are aligned by place; a word goes to its most frequent
    counterpart, if that is seen `least` times and makes up `share`."""
    same = pairs.filter(F.size(left) == F.size(right))
    aligned = same.select(F.explode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).alias("z")).select(F.col("z.a").alias("word"), F.col("z.b").alias("to"))
    counts = aligned.groupBy("word", "to").agg(F.count("*").alias("n"))
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    best = best_in_group(counts, ["word"], "n", "to").join(total, "word").withColumn("share", F.col("n") / F.col("total"))
    return best.filter((F.col("n") >= least) & (F.col("share") >= share)).drop("total")


def final_components(texts: DataFrame, components: str, least: int = 50, share: float = 0.5) -> DataFrame:
    """(component, n, share) of digit-free components that end a text `least` times, in `share` of their occurrences."""
    each = texts.select(F.posexplode(components).alias("at", "component"), F.size(components).alias("size"))
    counts = each.groupBy("component").agg(F.count("*").alias("seen"), F.count_if(F.col("at") == F.col("size") - 1).alias("n"))
    found = counts.withColumn("share", F.col("n") / F.col("seen")).filter((F.col("n") >= least) & (F.col("share") >= share))
    return found.filter(~F.col("component").rlike("[0-9]")).drop("seen")


def substitutions(pairs: DataFrame, left: str, right: str, least: int = 30, share: float = 0.5) -> DataFrame:
    """(word, to, n, share): where either side has one or two tokens of its own, each of one's stands for each of the other's."""
    own = pairs.select(F.array_except(left, right).alias("a"), F.array_except(right, left).alias("b"))
    few = own.filter(F.size("a").between(1, 2) & F.size("b").between(1, 2))
    both = few.select(F.explode("a").alias("word"), "b").select("word", F.explode("b").alias("to"))
    counts = both.groupBy("word", "to").agg(F.count("*").alias("n"))
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    kept = best_in_group(counts, ["word"], "n", "to").join(total, "word").withColumn("share", F.col("n") / F.col("total"))
    return kept.filter((F.col("n") >= least) & (F.col("share") >= share)).drop("total")


def added_words(true_pairs: DataFrame, look_alikes: DataFrame, left: str, right: str, support: int = 300) -> DataFrame:
    """(word, n_true, n_alike, rate): words that only the right side has, in true pairs and in look-alikes; rate is the
    +1-smoothed ratio of their shares. High rates are noise, low ones mark siblings."""

    def counted(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.select(F.explode(F.array_except(right, left)).alias("word")).groupBy("word").agg(F.count("*").alias(name))

    sizes = true_pairs.agg(F.count("*").alias("nt")).join(F.broadcast(look_alikes.agg(F.count("*").alias("na"))))
    both = counted(true_pairs, "n_true").join(counted(look_alikes, "n_alike"), "word", "full").na.fill(0)
    rate = ((F.col("n_true") + 1) / (F.col("nt") + 1)) / ((F.col("n_alike") + 1) / (F.col("na") + 1))
    return both.filter(F.col("n_true") + F.col("n_alike") >= support).join(F.broadcast(sizes)).select("word", "n_true", "n_alike", rate.alias("rate"))


def state_variants(pairs: DataFrame, known: DataFrame, rounds: int = 2, least: int = 20, purity: float = 0.95) -> DataFrame:
    """(component, state): components that stand where linked records name a known state, round by round.

    pairs (left, right: components of linked addresses), known (component, state). Each round learns the components that
    go with one state in `purity` of at least `least` pairs; the rounds are few and fixed.
    """
    for _ in range(rounds):
        side = pairs.select(F.element_at("left", -1).alias("component"), F.element_at("right", -1).alias("other"))
        seen = side.join(known.withColumnsRenamed({"component": "other"}), "other")
        new = seen.join(known.select("component"), "component", "left_anti")
        counts = new.groupBy("component", "state").agg(F.count("*").alias("n"))
        total = counts.groupBy("component").agg(F.sum("n").alias("total"))
        kept = counts.join(total, "component").filter((F.col("n") >= least) & (F.col("n") >= purity * F.col("total")))
        known = known.unionByName(kept.select("component", "state"))
    return known
