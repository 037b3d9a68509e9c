"""Pair features from tokens and their rarity, with array functions and one small join per pair side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDF_CAP = 12.0


def rarity(texts: DataFrame, tokens: str, cap: float = IDF_CAP) -> DataFrame:
    """(token, df, idf) over all texts: min(ln((n + 1) / (df + 1)), cap)."""
    n = texts.agg(F.count("*").alias("n"))
    df = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.least(F.log((F.col("n") + 1) / (F.col("df") + 1)), F.lit(cap)).alias("idf"))


def weighted_overlap(pairs: DataFrame, keys: list[str], left: str, right: str, idf: DataFrame, default: float = IDF_CAP) -> DataFrame:
    """keys with wjac, cont_l, cont_r (shared weight over the union's, the left's, the right's), unsh_l and unsh_r (the
    rarest token of one side alone, 0 without one). Null where a side has no token."""
    every = F.explode(F.array_union(left, right)).alias("token")
    each = pairs.filter((F.size(left) > 0) & (F.size(right) > 0)).select(*keys, left, right, every)
    each = each.select(*keys, "token", F.array_contains(left, F.col("token")).alias("l"), F.array_contains(right, F.col("token")).alias("r"))
    w = F.coalesce("idf", F.lit(default))
    d = each.join(idf.select("token", "idf"), "token", "left")
    l, r = F.col("l"), F.col("r")
    sums = d.groupBy(*keys).agg(
        F.sum(w).alias("union"),
        F.sum(F.when(l & r, w).otherwise(0.0)).alias("shared"),
        F.sum(F.when(l, w).otherwise(0.0)).alias("wl"),
        F.sum(F.when(r, w).otherwise(0.0)).alias("wr"),
        F.coalesce(F.max(F.when(l & ~r, w)), F.lit(0.0)).alias("unsh_l"),
        F.coalesce(F.max(F.when(r & ~l, w)), F.lit(0.0)).alias("unsh_r"),
    )
    share = lambda x: F.try_divide("shared", x)
    sums = sums.select(*keys, share(F.col("union")).alias("wjac"), share(F.col("wl")).alias("cont_l"), share(F.col("wr")).alias("cont_r"), "unsh_l", "unsh_r")
    return pairs.select(*keys).join(sums, keys, "left")


def set_overlap(left: Column, right: Column) -> Column:
    """Struct (jac, cont_l, cont_r) of two sets; null where either is empty."""
    both = F.size(F.array_intersect(left, right))
    known = (F.size(left) > 0) & (F.size(right) > 0)
    part = lambda n: F.when(known, both / n)
    return F.struct(
        part(F.size(F.array_union(left, right))).alias("jac"), part(F.size(F.array_distinct(left))).alias("cont_l"), part(F.size(F.array_distinct(right))).alias("cont_r")
    )


def share_known(tokens: Column, vocabulary: Column) -> Column:
    """The share of tokens that are in the vocabulary; null without a token."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.array_contains(vocabulary, t))) / F.size(tokens))
