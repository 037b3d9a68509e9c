"""Reports on candidates and decisions: what was missed, how many records are nobody's, how each part fares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_share, logit_shift


def misses(truth: DataFrame, candidates: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    """True pairs that no channel found, counted by what tells them apart."""
    return truth.join(candidates.select(*keys), keys, "left_anti").groupBy(*by).agg(F.count("*").alias("missed"))


def distractor_share(records: DataFrame, truth: DataFrame, record: list[str], *by: str) -> DataFrame:
    """The share of records that no entity owns."""
    owned = truth.select(*record).distinct().withColumn("_owned", F.lit(1))
    d = records.join(owned, record, "left")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("_owned").isNull().cast("int")), 9).alias("share"))


def distractor_weighted(pairs: DataFrame, truth: DataFrame, record: list[str], weight: float) -> DataFrame:
    """pairs with `weight` where nobody owns the record, else 1."""
    owned = truth.select(*record).distinct().withColumn("_owned", F.lit(True))
    return pairs.join(owned, record, "left").withColumn("weight", F.when(F.col("_owned"), 1.0).otherwise(weight)).drop("_owned")


def uncertain_and_some_easy(pairs: DataFrame, score: str, keys: list[str], low: float = 0.01, high: float = 0.99, share: float = 0.05, seed: int = 0) -> DataFrame:
    """The pairs whose score lies between low and high, and a share of the others, drawn by a hash of their keys."""
    uncertain = F.col(score).between(low, high)
    return pairs.withColumn("uncertain", uncertain).filter(uncertain | (hash_share(*map(F.col, keys), seed=seed) < share))


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows, alike in every run: those of the least hashes of their keys. Spark keeps n rows a task before it merges them."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def by_part(universe: DataFrame, offered: DataFrame, chosen: DataFrame, entity: str, part: str) -> DataFrame:
    """How each part fares: pairs chosen and offered an entity, entities without any, median and uncertain best scores.

    offered has of each entity how many pairs it is in, n_cand, and their best score, pmax."""
    n_pred = chosen.groupBy(entity).agg(F.count("*").alias("n_pred"))
    d = universe.join(n_pred, entity, "left").join(offered, entity, "left").na.fill(0, ["n_pred", "n_cand"])
    return d.groupBy(part).agg(
        F.count("*").alias("n_s1"), F.round(F.avg("n_pred"), 6).alias("pred_per_s1"), F.round(F.avg((F.col("n_pred") == 0).cast("int")), 6).alias("empty_share"),
        F.round(F.avg("n_cand"), 6).alias("cand_per_s1"), F.round(F.percentile("pmax", 0.5), 6).alias("pmax_median"), F.round(F.avg(F.col("pmax").between(0.2, 0.8).cast("int")), 6).alias("pmax_uncertain_share"),
    )


def anchored(entities: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that are alone with their keys, beside the records that have them too."""
    alone = entities.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")
    return alone.join(records, keys)


def shift_sweep(pairs: DataFrame, score: str, part: str, value: str, deltas: list[float], threshold: float, record: list[str]) -> DataFrame:
    """For each shift of one part's scores: its pairs that pass, and the share of its records that are matched."""
    own = pairs.filter(F.col(part) == value)
    shifted = own.withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    passes = logit_shift(F.col(score), F.col("delta")) >= threshold
    counts = shifted.groupBy("delta").agg(F.count_if(passes).alias("matched"), F.countDistinct(F.when(passes, F.struct(*record))).alias("_r"), F.countDistinct(F.struct(*record)).alias("_n"))
    return counts.select("delta", "matched", F.round(F.col("_r") / F.col("_n"), 9).alias("share"))


def finalised(new: DataFrame, prior: DataFrame, part: str, switched: list[str]) -> DataFrame:
    """The new decision's rows in the switched parts, the prior one's in all others."""
    return new.filter(F.col(part).isin(switched)).unionByName(prior.filter(~F.col(part).isin(switched)))


def best_of(scores: DataFrame, value: str, metric: str) -> DataFrame:
    """The one row of greatest metric; of equals that of the smallest value nearest 0."""
    return scores.orderBy(F.desc(metric), F.abs(value), value).limit(1)
