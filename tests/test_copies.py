"""Queries over part whose rows come in many copies: right, and without a row for every pair of copies."""

import os

import duckdb
import pytest
from test_queries import plain

from millrace.operators import pair_features
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
COPIES = 60
#: Most rows of a join in a query whose result has a row per record or less, over those of the table: pairs are 18 times as many.
MOST = 12
RECORDS = [
    "accept_added_words", "decide_by_part", "finalised_by_part", "expected_macro", "part_shift_sweep", "part_sanity", "tuned_threshold", "tuned_shift", "version_comparison",
]

#: Searches keep up to 20 pairs of a record.
SEARCHES = [
    "channel_union", "combined_view_topk", "channel_contribution", "reverse_rank",
]
MOST_FOUND = 60
#: A row for every pair: what it says is worked out before the rows are paired.
PAIRS = [
    "house_relation", "weighted_token_overlap", "fuzzy_ratios", "monge_elkan_pairs", "orphan_context", "cross_scorer_rows", "level_two_context", "level_three_context",
]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("copies"))
    n = duckdb.execute(f"SELECT max(p_partkey) + 1 FROM '{SF}/part.parquet'").fetchall()[0][0]
    duckdb.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * {n} AS p_partkey) FROM '{SF}/part.parquet' p, range({COPIES}) r(i)) TO '{folder}/part.parquet' (FORMAT parquet)")
    return folder


def joined(plan):
    """Rows that each join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below += [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return own + [n for x in below for n in joined(x)]


def compared(spark, folder, name):
    d = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    order, columns = [c[0] for c in cursor.description], sorted(d.columns)
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in d.collect()), key=repr) == want
    return d


@pytest.mark.parametrize("name", RECORDS)
def test_copies_are_not_paired(spark, copied, name):
    d = compared(spark, copied, name) if name in registry.oracle_sql() else registry.queries()[name](spark, copied)
    d.collect()
    rows = spark.read.parquet(os.path.join(copied, "part.parquet")).count()
    assert 0 < max(joined(d._jdf.queryExecution().executedPlan())) < MOST * rows


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_go_by_different_texts(spark, copied, name):
    d = compared(spark, copied, name)
    rows = spark.read.parquet(os.path.join(copied, "part.parquet")).count()
    assert 0 < max(joined(d._jdf.queryExecution().executedPlan())) < MOST_FOUND * rows


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_come_last(spark, copied, name):
    d = registry.queries()[name](spark, copied)
    rows = len(d.collect())
    assert sum(n >= rows for n in joined(d._jdf.queryExecution().executedPlan())) == 1
    above = d._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert not [x for x in ("Window", "ArrowEvalPython", "Aggregate", "levenshtein", "array_intersect") if x in above]


def test_features_of_copies_are_worked_out_once(spark, tmp_path, monkeypatch):
    """Scores of pair_features are those of different rows; as many pairs come to the kernels whatever the copies."""
    n = 36 * duckdb.execute(f"SELECT max(p_partkey) + 1 FROM '{SF}/part.parquet'").fetchall()[0][0]
    duckdb.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * {n} AS p_partkey) FROM '{SF}/part.parquet' p, range(6) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    given = []
    monkeypatch.setattr(pair_features, "fuzzy", lambda d, own=pair_features.fuzzy: given.append(d) or own(d))
    for folder in (SF, str(tmp_path)):
        registry.queries()["pair_features"](spark, folder)
    one, many = (d.count() for d in given)
    assert one == many > 0
