"""Joins that linkage needs beside the plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capped_key_join(entities: DataFrame, records: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Pairs with equal, non-empty keys, for keys that at most `cap` entities have.

    The cap is part of the definition: a key that more entities share says nothing. It also bounds the join's output
    by cap times the records, whatever the keys' distribution.
    """
    for key in keys:
        entities = entities.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    rare = entities.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") <= cap).drop("_n")
    return records.join(entities.join(rare, keys, "left_semi"), keys)


def rivals(pairs: DataFrame, group: list[str], identity: list[str], confident) -> DataFrame:
    """Each pair beside every other confident pair of its group: an equi-join with a residual that rules itself out."""
    other = pairs.filter(confident).select(*group, *[F.col(c).alias(f"other_{c}") for c in pairs.columns if c not in group])
    differs = F.lit(False)
    for c in identity:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return pairs.join(other, group).filter(differs)


def blended(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of either side with the mean of the values known: a full join, keys coalesced."""
    from millrace.functions.expressions import mean_known

    a = left.select(*keys, F.col(value).alias("_a"))
    b = right.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, mean_known("_a", "_b").alias(value))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where nulls equal each other; the keys come from the left."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, same, how).drop(*[f"_{c}" for c in keys])


def expanded(classes: DataFrame, left: DataFrame, right: DataFrame, block: list[str], l: list[str], r: list[str]) -> DataFrame:
    """Pairs of rows from pairs of classes (*block, *l, *r, ...): left (*block, *l, ...) and right (*block, *r, ...) have the rows.

    What a pair takes from its classes is worked out once for all copies. The rows of the right side come last, by sorted
    runs, so nothing but the two sides and the classes beside one of them is shuffled.
    """
    some = null_safe(classes, left, [*block, *l])
    return null_safe(some, right.hint("merge"), [*block, *r])
