"""Decision, metrics, sources, synthetic rows, learning."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as E
from millrace.operators import blocking as B
from millrace.operators import decision as D
from millrace.operators import grouping as G
from millrace.operators import learning as K
from millrace.operators import metrics as M
from millrace.operators import synthetic as Y
from millrace.plans import registry
from millrace.sources import linkage as L


def f_half(tp, n_true, n_pred):
    return 1.0 if n_true == n_pred == 0 else 1.25 * tp / (0.25 * n_true + n_pred)


def best_prefix(ps):
    best = (-1.0, 0)
    for k in range(len(ps) + 1):
        e = 0.0
        for outcome in itertools.product((0, 1), repeat=len(ps)):
            w = 1.0
            for p, o in zip(ps, outcome, strict=True):
                w *= p if o else 1 - p
            e += w * f_half(sum(outcome[:k]), sum(outcome), k)
        if round(e, 9) > best[0]:
            best = (round(e, 9), k)
    return best[1]


def test_best_prefix_equals_enumeration(spark):
    r = random.Random(3)
    cases = [sorted((round(r.random(), 3) for _ in range(r.randrange(1, 9))), reverse=True) for _ in range(120)]
    d = spark.createDataFrame([(i, ps) for i, ps in enumerate(cases)], "i int, ps array<double>")
    got = {x["i"]: x["k"] for x in d.select("i", D.best_prefix(F.col("ps"))["k"].alias("k")).collect()}
    assert got == {i: best_prefix(ps) for i, ps in enumerate(cases)}


def test_select_expected_f_keeps_prefixes(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.01), (2, 4, 0.2), (3, 5, 0.001)], "s1 int, rid int, p double")
    assert {(x["s1"], x["rid"]) for x in D.select_expected_f(d, "p", ["s1"], "rid").collect()} == {(1, 1), (1, 2)}


def expected_by_counts(ps, k):
    """Expected F0.5 of the first k by the distributions of what is taken and what is left."""

    def counts(x):
        d = [1.0]
        for p in x:
            d = [a * (1 - p) + b * p for a, b in zip([*d, 0.0], [0.0, *d], strict=True)]
        return d

    return sum(a * b * f_half(i, i + j, k) for i, a in enumerate(counts(ps[:k])) for j, b in enumerate(counts(ps[k:])))


def test_prefixes_of_long_lists(spark):
    r = random.Random(5)
    lists = [sorted((round(r.random() * top, digits) for _ in range(n)), reverse=True) for n, top, digits in ((31, 1, 6), (64, 1, 1), (90, 0.1, 2), (40, 0.5, 6))]
    lists += [[0.9] * 45, [1.0] * 33 + [0.0] * 7]
    d = spark.createDataFrame([(i, ps) for i, ps in enumerate(lists)], "i int, ps array<double>").withColumn("b", D.best_prefix(F.col("ps")))
    rows = spark.createDataFrame([(i, rid, p) for i, ps in enumerate(lists) for rid, p in enumerate(ps)], "s1 int, rid int, p double").filter("p > 0")
    kept = {x["s1"]: (x["n"], x["last"]) for x in D.select_expected_f(rows, "p", ["s1"], "rid", floor=0.0).groupBy("s1").agg(F.count("*").alias("n"), F.max("rid").alias("last")).collect()}
    for x in d.collect():
        options = [round(expected_by_counts(x["ps"], k), 9) for k in range(len(x["ps"]) + 1)]
        assert x["b"]["k"] == options.index(max(options)) and abs(x["b"]["ef"] - max(options)) < 3e-9
        assert kept[x["i"]] == (x["b"]["k"], x["b"]["k"] - 1)
    assert kept[4][0] == 45 and kept[5][0] == 33


def test_expected_queries_take_all_records_of_an_entity(spark, tmp_path):
    rows = [(i * 3 + (i > 0), "red ring", "Brand#1", "SMALL", 1) for i in range(81)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["expected_macro"](spark, str(tmp_path)).first()
    assert tuple(got) == ("SMALL", 1, round(expected_by_counts([0.98] * 80, 80), 6), 80.0)
    assert registry.queries()["tuned_shift"](spark, str(tmp_path)).filter("macro_f < 1").count() == 0


def test_metric_examples(spark):
    universe = spark.createDataFrame([(i,) for i in range(1, 6)], "s1 int")
    truth = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 3, 5), (2, 2, 3), (4, 3, 9), (9, 2, 1)], "s1 int, src int, rid int")
    pred = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 2, 7), (1, 2, 1), (3, 3, 1), (4, 3, 9)], "s1 int, src int, rid int")
    got = {x["s1"]: round(x["f"], 4) for x in D.per_entity(pred, truth, universe, "s1", ["src", "rid"]).collect()}
    assert got == {1: 0.6667, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0}
    assert M.macro(pred, truth, universe, "s1", ["src", "rid"]).first()["n"] == 5


def test_gap_and_ranks(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 3, 0.4), (3, 4, None), (3, 5, 0.1)], "g int, i int, v double")
    rows = d.select("i", G.gap_to_rival(["g"], "v", "i").alias("gap"), G.ranked(["g"], "v", "i", nulls_unranked=True).alias("rk")).collect()
    got = {x["i"]: (None if x["gap"] is None else round(x["gap"], 6), x["rk"]) for x in rows}
    assert got == {1: (0.4, 1), 2: (-0.4, 2), 3: (0.4, 1), 4: (None, None), 5: (0.1, 1)}


def test_expressions(spark):
    d = spark.createDataFrame([("a", "a", "1", 0.5), ("a", "b", "x", float("nan")), ("", "b", "", None)], "a string, b string, n string, v double")
    rows = d.select(E.tri_equal(F.col("a"), F.col("b")).alias("t"), E.lenient_int(F.col("n")).alias("n"), E.fill(F.col("v")).alias("v"), E.grams(F.lit("abcd")).alias("g")).collect()
    assert [tuple(r[:3]) for r in rows] == [(1, 1, 0.5), (0, None, 0.0), (-1, None, 0.0)] and rows[0]["g"] == ["abc", "bcd"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_top_k_is_the_same_on_any_partitioning(spark, partitions):
    docs = [("p", "entity" if i % 3 == 0 else "record", i, [f"t{(i * j) % 11}" for j in range(1, 6)]) for i in range(60)]
    d = spark.createDataFrame(docs, "part string, side string, id long, terms array<string>").repartition(partitions)
    top = B.top_k(B.similarities(B.tf_idf(d, "terms", 0.9), "entity", "record"), 3)
    got = sorted((r["id"], r["rank"], r["entity_id"], r["score"]) for r in top.collect())
    assert got[:3] and [r[:2] for r in got] == sorted({r[:2] for r in got})
    if not hasattr(test_top_k_is_the_same_on_any_partitioning, "seen"):
        test_top_k_is_the_same_on_any_partitioning.seen = got
    assert got == test_top_k_is_the_same_on_any_partitioning.seen


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_contract(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    good = write(tmp_path / "a.tsv", head + 'S2-1\t"Quoted" name\t\tUS\nS2-2\tOther\t1 Main St\tUS\n')
    d = L.load_source(spark, good, 2, expected_rows=2)
    assert [tuple(r) for r in d.orderBy("entity_id").collect()] == [(2, "S2-1", '"Quoted" name', "", "US"), (2, "S2-2", "Other", "1 Main St", "US")]
    for text, rows, what in ((head + "S3-1\ta\tb\tc\n", None, "another source"), (head + "S2-1\ta\tb\tc\nS2-1\ta\tb\tc\n", None, "repeat"), (head + "S2-1\ta\tb\tc\n", 5, "expected 5")):
        with pytest.raises(ValueError, match=what):
            L.load_source(spark, write(tmp_path / "b.tsv", text), 2, rows)
    with pytest.raises(ValueError, match="columns"):
        L.read_tsv(spark, write(tmp_path / "c.tsv", "x\ty\n1\t2\n"))


def test_lists_round_trip(spark, tmp_path):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S3-2"), ("S1-3", "S2-1")], "source1_entity_id string, id string")
    lists = L.id_lists(entities, pairs, "source1_entity_id", "id", "matched_entity_ids")
    L.write_lists(lists, str(tmp_path / "out"), "source1_entity_id")
    back = {r[0]: r[1] for r in L.read_lists(spark, str(tmp_path / "out")).collect()}
    assert back == {"S1-1": ["S2-9", "S3-2"], "S1-2": [], "S1-3": ["S2-1"]}
    records = spark.createDataFrame([(2, "S2-9"), (3, "S3-2")], "src int, entity_id string")
    truth = L.load_truth(L.read_lists(spark, str(tmp_path / "out")), entities.withColumnRenamed("source1_entity_id", "entity_id"), records)
    assert {tuple(r) for r in truth.collect()} == {("S1-1", 2, "S2-9"), ("S1-1", 3, "S3-2")}


def test_contract_violations(spark):
    entities = spark.createDataFrame([(1,), (2,)], "id int")
    lists = spark.createDataFrame([(1, ["a", "a"]), (3, ["b"])], "id int, ids array<string>")
    allowed = spark.createDataFrame([(1, ["a"])], "id int, ids array<string>")
    got = {r["problem"]: r["n"] for r in L.contract_violations(entities, lists, allowed).collect()}
    assert got == {"missing entity": 1, "unknown entity": 1, "repeated id": 1, "not a candidate": 1}


def test_synthetic_rows(spark):
    d = spark.createDataFrame([("Acme Mills, Ltd", "007 Elm 7 St", "7"), ("ACME", "no number", ""), ("acme llc", "12-14 Elm", "14")], "name string, addr string, house string")
    got = [tuple(r) for r in d.select(Y.insert_word(F.col("name"), F.lit("East"), ["ltd", "llc"]), Y.shift_house(F.col("addr"), F.col("house"), F.lit(2))).collect()]
    assert got == [("Acme Mills East, Ltd", "009 Elm 7 St"), ("ACME EAST", "no number"), ("acme east llc", "12-16 Elm")]


def test_splits_are_disjoint_and_stable(spark):
    d = K.split(spark.range(5000), "id")
    got = d.agg(F.avg(F.col("dropped").cast("int")), F.avg(F.col("holdout").cast("int")), F.min("fold"), F.max("fold"), F.count_if((F.col("dropped") | F.col("holdout")) & (F.col("fold") >= 0))).first()
    assert abs(got[0] - 0.21) < 0.03 and abs(got[1] - 0.79 * 0.2) < 0.03 and tuple(got[2:]) == (-1, 4, 0)
    assert d.exceptAll(K.split(spark.range(5000).repartition(9), "id")).count() == 0


def test_calibration_pools_and_clips(spark):
    d = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "s double, y int")
    fitted = K.Calibration.fit(d, "s", "y")
    p = {r["s"]: round(r["p"], 6) for r in fitted.apply(d.select("s").union(spark.createDataFrame([(5.0,), (-5.0,)], "s double")), "s", "p").collect()}
    assert p[0.2] == p[0.3] == 0.5 and p[0.1] == p[-5.0] == 1e-6 and p[0.9] == p[5.0] == 1 - 1e-6


def test_scores_are_taken_over(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "z")], "k int, l string, r string")
    known = spark.createDataFrame([(1, -3.0)], "k int, ce double")
    got = {r["k"]: round(r["ce"], 3) for r in K.scored_by(pairs, K.OverlapScorer(), "l", "r", "ce", known, ["k"]).collect()}
    assert got == {1: -3.0, 2: -6.907}


def test_dictionaries_and_parts(spark, tmp_path):
    from millrace.sources import dictionaries as S

    at = str(tmp_path / "words")
    assert S.read_dictionary(spark, at) == {}
    S.write_dictionary(spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y"), (None, "z")], "k string, v string"), at, "k", "v")
    assert S.read_dictionary(spark, at) == {"a": "b", "x": "y"}
    S.write_by_part(spark.range(6).selectExpr("id", "id % 2 AS country"), str(tmp_path / "by"), "country")
    one = spark.read.parquet(str(tmp_path / "by")).filter("country = 1")
    assert sorted(r["id"] for r in one.collect()) == [1, 3, 5] and "PartitionFilters: [isnotnull(country" in one._jdf.queryExecution().toString()


def test_stages_are_built_once(spark, tmp_path):
    from millrace.plans.linkage import Settings, Stages

    built = []
    build = lambda: (built.append(1), spark.range(3))[1]
    for settings in (Settings(), Settings(), Settings(seed=1)):
        assert Stages(spark, str(tmp_path / "s"), settings=settings)("x", build).count() == 3
    assert len(built) == 2


def test_best_of_is_the_first_of_equals(spark):
    from millrace.operators.diagnostics import best_of

    d = spark.createDataFrame([(-0.5, 0.7), (0.0, 0.7), (0.5, 0.2)], "delta double, f double")
    assert best_of(d, "delta", "f").first()["delta"] == 0.0
