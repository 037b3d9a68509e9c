"""A whole linkage, from raw entities and records to the pairs that are kept, as one graph of DataFrames.

Stages are kept as Parquet under a folder, and read from there if they are there already; `report` has what each one took.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions.expressions import grams
from millrace.operators import blocking as B
from millrace.operators import decision as D
from millrace.operators import learning as K
from millrace.operators import pair_features as P
from millrace.operators.grouping import best_in_group, ranked
from millrace.operators.joins import capped_key_join


@dataclass(frozen=True)
class Settings:
    """Sizes and bounds of a linkage; the defaults are those of the final runs that this engine's figures compare with."""

    k_name: int = 30
    k_addr: int = 25
    k_comb: int = 30
    k_reverse: int = 30
    k_wide: int = 90
    k_empty: int = 100
    key_cap: int = 50
    max_df_name: float = 0.01
    max_df_addr: float = 0.02
    prune_top: int = 60
    prune_floor: float = 2e-5
    entity_cap: int = 150
    folds: int = 5
    seed: int = 2026


@dataclass
class Stages:
    """Results by name: built once, kept under `folder`, which all executors share, with the seconds that each took.

    Results lie in a folder of their settings, so others never get them; one that is there is read, and nothing is built.
    """

    spark: SparkSession
    folder: str
    settings: Settings = field(default_factory=Settings)
    report: dict[str, float] = field(default_factory=dict)

    def __call__(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        mark = hashlib.md5(repr(self.settings).encode()).hexdigest()[:12]
        path, began = f"{self.folder}/{mark}/{name}", time.perf_counter()
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            build().write.mode("overwrite").parquet(path)
        self.report[name] = self.report.get(name, 0.0) + time.perf_counter() - began
        return self.spark.read.parquet(path)


def normalised(raw: DataFrame, known: N.Dictionaries = N.Dictionaries()) -> DataFrame:
    """raw (id, name, addr, country, ...) with name and address views."""
    d = raw.withColumns({"_n": N.name_views_udf(known)("name"), "_a": N.address_views_udf(known)("addr", "country")})
    return d.select(*raw.columns, "_n.*", "_a.*")


def candidates(entities: DataFrame, records: DataFrame, s: Settings) -> DataFrame:
    """(part, id, entity_id, ranks by channel, key flags, cosines) of normalised entities (s1, country) and records (rid, src, country).

    A record's id in the search is src and rid together.
    """
    e = entities.withColumnsRenamed({"country": "part"}).withColumn("id", F.col("s1").cast("string")).withColumn("side", F.lit("entity"))
    r = records.withColumnsRenamed({"country": "part"}).withColumn("id", F.concat_ws(":", "src", "rid")).withColumn("side", F.lit("record"))
    columns = ["part", "side", "id", "n_core", "n_key", "a_tok", "a_house", "a_street", "addr"]
    docs = e.select(*columns).unionByName(r.select(*columns))
    compact = F.replace("n_core", F.lit(" "), F.lit(""))
    padded = F.when(compact != "", F.concat(F.lit(" "), compact, F.lit(" "))).otherwise("")
    words = F.concat(F.filter(F.split("a_tok", " "), lambda w: w != ""), N.identifiers(F.col("addr")))
    docs = docs.withColumns({"_grams": grams(padded), "_words": words})
    name, addr = B.tf_idf(docs, "_grams", s.max_df_name), B.tf_idf(docs, "_words", s.max_df_addr)
    best = lambda v, k: B.top_k(B.similarities(v, "entity", "record"), k)
    bare = B.without_vector(docs.select("part", "side", "id"), addr, "record").select("part", "id")
    bare_names = name.filter("side = 'entity'").unionByName(name.filter("side = 'record'").join(bare, ["part", "id"], "left_semi").select(*name.columns))
    wide = best(B.stacked(name, addr), s.k_wide).withColumn("src", F.split("id", ":")[0])
    wide = wide.withColumn("reverse", F.least(ranked(["entity_id", "src"], "score", "id") - 1, F.lit(127)))
    channels = {
        "r_name": best(name, s.k_name),
        "r_addr": best(addr, s.k_addr),
        "r_addrc": best(B.containment(addr, "entity"), s.k_addr),
        "r_nwide": best(bare_names, s.k_empty),
        "r_comb": wide.filter(F.col("rank") < s.k_comb),
        "r_rev": wide.filter(F.col("reverse") < s.k_reverse).withColumn("rank", F.col("reverse")),
    }
    left, right = docs.filter("side = 'entity'").withColumnRenamed("id", "entity_id"), docs.filter("side = 'record'")
    keys = {
        flag: capped_key_join(left.select("part", "entity_id", *on), right.select("part", "id", *on), ["part", *on], s.key_cap)
        for flag, on in (("k_name", ["n_key"]), ("k_addr", ["a_house", "a_street"]))
    }
    u = B.union_channels(channels, keys, ["part", "id", "entity_id"])
    u = B.pair_cosine(B.pair_cosine(u, name, "entity", "record", "cos_name"), addr, "entity", "record", "cos_addr")
    u = u.withColumn("cos_comb", (F.col("cos_name") + F.col("cos_addr")) / 2)
    half = F.split("id", ":")
    return u.withColumns({"s1": F.col("entity_id").cast("long"), "src": half[0].cast("int"), "rid": half[1].cast("long")}).drop("id", "entity_id")


RANKER = ["cos_name", "cos_addr", "cos_comb", "k_name", "k_addr", "s1_max", "s1_n", "rec_max", "rec_rank", "rec_n", "rec_gap", "s1_gap", "rec_gap_name", "rec_gap_addr"]


def pruned(pairs: DataFrame, truth: DataFrame, split: DataFrame, s: Settings) -> DataFrame:
    """pairs with p0 by a cross-fitted ranker, cut to each record's and each entity's best."""
    y = truth.select("s1", "src", "rid").distinct().withColumn("y", F.lit(1.0))
    d = P.ranker_context(pairs).join(y, ["s1", "src", "rid"], "left").join(split.select("s1", "fold"), "s1").na.fill(0.0, ["y"])
    d = K.assembled(d, RANKER)
    first, second = F.col("fold").isin(0, 1), F.col("fold").isin(2, 3)
    make = lambda: LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-3)
    scored = K.cross_fitted(d, "y", "p0", {"a": (first, ~first), "b": (second, first)}, make).drop("features")
    top = best_in_group(scored.filter(F.col("p0") >= s.prune_floor), ["src", "rid"], "p0", "s1", k=s.prune_top)
    return best_in_group(top, ["s1"], "p0", "src", "rid", k=s.entity_cap)


LEARNT = ["p0", "cos_name", "cos_addr", "fn_ratio", "fn_tset", "fn_jw", "fa_ratio", "fa_tset", "fs_ratio", "house_eq", "street_eq", "key_eq", "core_eq", "legal_eq", "rec_gap", "s1_gap", "rec_rank"]


def scored(pairs: DataFrame, entities: DataFrame, records: DataFrame, s: Settings) -> DataFrame:
    """pairs with p: out-of-fold scores on fuzzy and structural features, calibrated on the folds."""
    views = [*N.NAME_VIEWS, *N.ADDRESS_VIEWS, "n_nl", "n_alias", "a_empty"]
    d = pairs.join(entities.select("s1", *[F.col(v).alias(f"l_{v}") for v in views]), "s1")
    d = d.join(records.select("src", "rid", *[F.col(v).alias(f"r_{v}") for v in views]), ["src", "rid"])
    d = P.fuzzy(d).withColumns(P.structural(F.array().cast("array<string>")))
    d = K.assembled(d.select("part", "s1", "src", "rid", "fold", "y", *LEARNT), LEARNT).drop(*LEARNT).persist()
    make = lambda: LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-3)
    raw = K.out_of_fold(d, "y", "raw", s.folds, make).drop("features").persist()
    return K.Calibration.fit(raw.filter("fold >= 0"), "raw", "y").apply(raw, "raw", "p")


def link(entities: DataFrame, records: DataFrame, truth: DataFrame, run: Stages, s: Settings = Settings()) -> DataFrame:
    """(s1, src, rid, p) of the pairs kept.

    entities (s1, name, addr, country), records (rid, src, name, addr, country), truth (s1, src, rid) of entities whose
    owners are known. Each record goes to its best entity; each entity keeps the subset of greatest expected F0.5.
    """
    run = replace(run, settings=s)
    e = run("norm_entities", lambda: normalised(entities))
    r = run("norm_records", lambda: normalised(records))
    split = run("splits", lambda: K.split(entities.select("s1"), "s1", drop=0.0, folds=s.folds, seed=s.seed))
    pairs = run("candidates", lambda: candidates(e, r, s))
    few = run("pruned", lambda: pruned(pairs, truth, split, s))
    p = run("scored", lambda: scored(few, e, r, s))
    best = D.partition(p.select("s1", "src", "rid", "p"), "p", ["src", "rid"], "s1")
    return run("kept", lambda: D.select_expected_f(best, "p", ["s1"], "src", "rid").select("s1", "src", "rid", F.round("p", 6).alias("p")))
