"""Linkage metrics: macro F0.5 and its breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.decision import per_entity


def macro(pred: DataFrame, truth: DataFrame, universe: DataFrame, entity: str, record: list[str]) -> DataFrame:
    """(n, macro_f): the mean F0.5 over every entity of the universe."""
    return per_entity(pred, truth, universe, entity, record).agg(F.count("*").alias("n"), F.avg("f").alias("macro_f"))


def size_bucket(n):
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def breakdown(scores: DataFrame, country: str) -> DataFrame:
    """(country, size, n, f) in total, by country, by number of true records, and by both: one pass of grouping sets."""
    d = scores.withColumn("size", size_bucket(F.col("n_true")))
    sets = [[country, "size"], [country], ["size"], []]
    return d.groupingSets([[F.col(c) for c in s] for s in sets], F.col(country), F.col("size")).agg(F.count("*").alias("n"), F.avg("f").alias("f"))


def by_source(pred: DataFrame, truth: DataFrame, entity: str, source: str, record: list[str]) -> DataFrame:
    """Pair precision and recall of each source."""
    keys = [entity, source, *record]
    p = pred.select(*keys).distinct().select(*keys, F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = truth.select(*keys).distinct().select(*keys, F.lit(0).alias("p"), F.lit(1).alias("t"))
    both = p.unionByName(t).groupBy(*keys).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    tp = F.sum(F.col("p") * F.col("t"))
    return both.groupBy(source).agg(
        F.sum("p").alias("n_pred"),
        F.sum("t").alias("n_true"),
        tp.alias("tp"),
        (tp / F.greatest(F.sum("p"), F.lit(1))).alias("precision"),
        (tp / F.greatest(F.sum("t"), F.lit(1))).alias("recall"),
    )


def error_types(pred: DataFrame, truth: DataFrame, candidates: DataFrame, entity: str, record: list[str]) -> DataFrame:
    """False positives that nobody owns or another entity does; false negatives that blocking or the model lost."""
    keys = [entity, *record]
    wrong = pred.select(*keys).distinct().join(truth.select(*keys).distinct(), keys, "left_anti")
    owned = wrong.join(truth.select(*record).distinct().withColumn("_owned", F.lit(True)), record, "left")
    missed = truth.select(*keys).distinct().join(pred.select(*keys).distinct(), keys, "left_anti")
    seen = missed.join(candidates.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    fp = owned.select(F.when(F.col("_owned"), "fp_wrong_entity").otherwise("fp_distractor").alias("error"))
    fn = seen.select(F.when(F.col("_seen"), "fn_model_miss").otherwise("fn_blocking_miss").alias("error"))
    return fp.union(fn).groupBy("error").agg(F.count("*").alias("n"))
