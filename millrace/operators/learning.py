"""Splits, cross-fitting, calibration and stacking with Spark ML. Vectors have no missing value: each column that may
miss one brings a flag beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import clip, fill, hash_share


def split(entities: DataFrame, key: str, drop: float = 0.21, holdout: float = 0.2, sample: float = 0.25, folds: int = 5, seed: int = 2026) -> DataFrame:
    """entities with dropped, holdout, fold (-1 for dropped or held out) and in_sample, by independent hashes of the key."""
    coin = lambda k: hash_share(F.col(key), seed=seed + k)
    dropped = coin(1) < drop
    held = ~dropped & (coin(2) < holdout)
    fold = F.when(dropped | held, -1).otherwise(F.floor(coin(3) * folds).cast("int"))
    return entities.withColumns({"dropped": dropped, "holdout": held, "fold": fold, "in_sample": coin(4) < sample})


def easy_negatives_weighted(pairs: DataFrame, score: str, label: str, keys: list[str], below: float = 0.02, keep: float = 0.15, seed: int = 1) -> DataFrame:
    """pairs without most of the negatives that score below `below`; a `keep` share stays, with weight 1 / keep."""
    easy = (F.col(score) < below) & (F.col(label) == 0)
    kept = pairs.filter(~easy | (hash_share(*map(F.col, keys), seed=seed) < keep))
    return kept.withColumn("weight", F.when(easy, 1.0 / keep).otherwise(1.0))


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """A vector of the columns, 0 where one is missing, and of a flag for each that it is."""
    clean = df.withColumns({f"_{c}": fill(F.col(c).cast("double")) for c in columns} | {f"_{c}_missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in columns})
    names = [f"_{c}" for c in columns] + [f"_{c}_missing" for c in columns]
    return VectorAssembler(inputCols=names, outputCol=out).transform(clean).drop(*names)


def probability(model, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def booster(label: str, seed: int = 7, rounds: int = 20, depth: int = 4, weight: str | None = None) -> GBTClassifier:
    extra = {"weightCol": weight} if weight else {}
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed, **extra)


def cross_fitted(df: DataFrame, label: str, name: str, groups: dict[str, tuple[Column, Column]], make) -> DataFrame:
    """df with a score from models that haven't seen the row: groups maps a name to (rows to fit, rows to score)."""
    out = None
    for fit_rows, score_rows in groups.values():
        model = make().fit(df.filter(fit_rows))
        part = probability(model, df.filter(score_rows), name)
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, label: str, name: str, folds: int, make) -> DataFrame:
    """Each fold's rows scored by the model of the other folds, fold -1 by the mean of all models."""
    models = [make().fit(df.filter((F.col("fold") >= 0) & (F.col("fold") != k))) for k in range(folds)]
    parts = [probability(m, df.filter(F.col("fold") == k), name) for k, m in enumerate(models)]
    rest = df.filter(F.col("fold") < 0)
    for k, m in enumerate(models):
        rest = probability(m, rest, f"_{name}{k}")
    columns = [f"_{name}{k}" for k in range(folds)]
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / folds
    whole = rest.withColumn(name, mean).drop(*columns)
    for part in parts:
        whole = whole.unionByName(part)
    return whole


class Calibration:
    """Isotonic regression from a score to a probability, kept off 0 and 1; scores beyond those seen take the end values."""

    def __init__(self, fitted, edge: float = 1e-6):
        self.fitted, self.edge = fitted, edge

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str) -> Calibration:
        vector = VectorAssembler(inputCols=[score], outputCol="_v").transform(df.select(score, F.col(label).cast("double").alias(label)))
        return cls(IsotonicRegression(featuresCol="_v", labelCol=label, predictionCol="_p").fit(vector))

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        vector = VectorAssembler(inputCols=[score], outputCol="_v").transform(df)
        p = self.fitted.transform(vector)
        return p.withColumn(out, clip(F.col("_p"), self.edge, 1 - self.edge)).drop("_v", "_p")


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def combined(df: DataFrame, first: str, second: str, label: str, out: str, low: float, high: float, fit_rows: Column) -> DataFrame:
    """A logistic combiner of two scores and their product, in the band of the first where the second is known; else the first.

    second is a logit; fit_rows are those that the second scorer hasn't learnt from.
    """
    d = df.withColumns({"_a": logit(F.col(first)), "_b": F.coalesce(F.col(second), F.lit(0.0))}).withColumn("_c", F.col("_a") * F.col("_b"))
    band = F.col(first).between(low, high) & F.col(second).isNotNull()
    d = VectorAssembler(inputCols=["_a", "_b", "_c"], outputCol="features").transform(d)
    model = LogisticRegression(labelCol=label, featuresCol="features", regParam=1e-3).fit(d.filter(band & fit_rows))
    scored = probability(model, d, "_p")
    return scored.withColumn(out, F.when(band, F.col("_p")).otherwise(F.col(first))).drop("_a", "_b", "_c", "_p", "features")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n, n_pos, auc) by average ranks, equal scores sharing theirs: aggregates by distinct score, then one running sum."""
    from pyspark.sql import Window

    groups = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scored = groups.withColumn("_w", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    total, pos = F.sum("n"), F.sum("pos")
    return scored.agg(total.alias("n"), pos.cast("long").alias("n_pos"), F.try_divide(F.sum("_w"), pos * (total - pos)).alias("auc"))


class PairScorer:
    """What an outside model has to offer: a logit for each pair of texts of a batch. `load` runs once a task."""

    def load(self):
        return self

    def score(self, left: list[str], right: list[str]) -> list[float]:
        raise NotImplementedError


class OverlapScorer(PairScorer):
    """A stand-in without weights: the logit of the texts' word overlap."""

    def score(self, left, right):
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = set((a or "").lower().split()), set((b or "").lower().split())
            p = min(max(len(x & y) / max(1, len(x | y)), 1e-3), 1 - 1e-3)
            out.append(math.log(p / (1 - p)))
        return out


def scored_by(pairs: DataFrame, scorer: PairScorer, left: str, right: str, out: str, known: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """pairs with the scorer's logit; only pairs that `known` (keys, out) lacks are scored."""
    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ready = scorer.load()
        for a, b in batches:
            yield pa.array(ready.score(a.to_pylist(), b.to_pylist()), pa.float64())

    new = pairs if known is None else pairs.join(known, keys, "left_anti")
    fresh = new.withColumn(out, run(left, right))
    return fresh if known is None else fresh.unionByName(pairs.join(known.select(*keys, out), keys))
