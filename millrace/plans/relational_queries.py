"""Windows, joins, aggregates, decisions and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import expressions as E
from millrace.operators import decision as D
from millrace.operators import grouping as G
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.plans.registry import query
from millrace.plans.roles import SQL_PARTS, part_pairs, parts, table

_PAIRS = f"""WITH {SQL_PARTS},
pr AS (SELECT part, name, l.id AS l_id, r.id AS r_id, r.src AS r_src, l.house AS l_house, r.house AS r_house, l.street AS l_street, r.street AS r_street
  FROM p l JOIN p r USING (part, name) WHERE l.src = 1 AND r.src > 1)"""


@query(
    "tri_equality",
    f"""{_PAIRS}, e AS (SELECT CASE WHEN l_id % 5 = 0 THEN '' ELSE l_house END AS lh, r_house AS rh, l_street, r_street FROM pr)
SELECT CASE WHEN lh = '' OR rh = '' THEN -1 WHEN lh = rh THEN 1 ELSE 0 END AS house_eq,
  CASE WHEN l_street = r_street THEN 1 ELSE 0 END AS street_eq, count(*) AS n FROM e GROUP BY ALL""",
)
def tri_equality(spark, sf_dir):
    """Equal, different or missing, counted over look-alike pairs."""
    d = part_pairs(spark, sf_dir).withColumn("lh", F.when(F.col("l_id") % 5 == 0, "").otherwise(F.col("l_house")))
    flags = d.select(E.tri_equal(F.col("lh"), F.col("r_house")).alias("house_eq"), E.tri_equal(F.col("l_street"), F.col("r_street")).alias("street_eq"))
    return flags.groupBy("house_eq", "street_eq").agg(F.count("*").alias("n"))


_NUM = "try_cast(l_house AS BIGINT)", "try_cast(r_house AS BIGINT)"


@query(
    "house_relations",
    f"""{_PAIRS}
SELECT l_id, r_id, CAST(l_house LIKE r_house || '%' OR l_house LIKE '%' || r_house OR r_house LIKE l_house || '%' OR r_house LIKE '%' || l_house AS INT) AS house_affix,
  CAST({_NUM[1]} BETWEEN {_NUM[0]} AND {_NUM[0]} + 4 AS INT) AS house_range, round(ln(1 + abs({_NUM[0]} - {_NUM[1]})::DOUBLE), 6) AS house_logdiff,
  CAST(levenshtein(l_house, r_house) = 1 AS INT) AS house_one_edit
FROM pr""",
)
def house_relations(spark, sf_dir):
    """Numeric and textual relations of house numbers: affix, range, log distance, one edit."""
    d = part_pairs(spark, sf_dir)
    lh, rh = F.col("l_house"), F.col("r_house")
    li, ri = E.lenient_int(lh), E.lenient_int(rh)
    affix = lh.startswith(rh) | lh.endswith(rh) | rh.startswith(lh) | rh.endswith(lh)
    return d.select(
        "l_id", "r_id", affix.cast("int").alias("house_affix"), ri.between(li, li + 4).cast("int").alias("house_range"),
        F.round(F.log1p(F.abs(li - ri).cast("double")), 6).alias("house_logdiff"), (F.levenshtein(lh, rh) == 1).cast("int").alias("house_one_edit"),
    )


@query(
    "group_gap",
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rk, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS mx,
    nth_value(l_extendedprice, 2) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, rk::BIGINT AS rk, n, round(v - CASE WHEN rk = 1 THEN coalesce(second, 0) ELSE mx END, 4) AS gap FROM r""",
)
def group_gap(spark, sf_dir):
    """A line's price less that of the best other line of its order."""
    d = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice"))
    g, ties = ["l_orderkey"], ("l_linenumber", "l_partkey")
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", G.ranked(g, "v", *ties).cast("long").alias("rk"), G.size_of(g).alias("n"),
        F.round(G.gap_to_rival(g, "v", *ties), 4).alias("gap"),
    )


@query(
    "leave_one_out",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER w - l_quantity, 4) AS others,
  sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) OVER w - CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big_others
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def leave_one_out(spark, sf_dir):
    """Sums and conditional counts of the other lines of an order."""
    big = F.when(F.col("l_quantity") > 25, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(G.others_sum(["l_orderkey"], F.col("l_quantity")), 4).alias("others"), G.others_sum(["l_orderkey"], big).alias("big_others")
    )


@query(
    "rank_cap_two_level",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v FROM lineitem WHERE l_discount >= 0.01
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, l_linenumber, l_partkey) <= 3)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM a QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_orderkey, l_linenumber, l_partkey) <= 20""",
)
def rank_cap_two_level(spark, sf_dir):
    """The three best lines of an order, then the twenty best of those for a supplier."""
    d = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.01").withColumn("v", F.col("l_extendedprice"))
    a = G.best_in_group(d, ["l_orderkey"], "v", "l_linenumber", "l_partkey", k=3)
    b = G.best_in_group(a, ["l_suppkey"], "v", "l_orderkey", "l_linenumber", "l_partkey", k=20)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "best_per_record",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def best_per_record(spark, sf_dir):
    """Each customer's best order: the partition step of linkage."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return D.partition(o, "o_totalprice", ["o_custkey"], "o_orderkey")


@query(
    "ranked_nullable",
    """SELECT o_orderkey, v, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC NULLS LAST, o_orderkey) END::BIGINT AS rk
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)""",
)
def ranked_nullable(spark, sf_dir):
    """Ranks of a score that may be missing: missing ones stay unranked."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return o.select("o_orderkey", "v", G.ranked(["o_custkey"], "v", "o_orderkey", nulls_unranked=True).cast("long").alias("rk"))


@query(
    "freq_tables",
    f"""WITH {SQL_PARTS}, f1 AS (SELECT part, name, count(*) AS n FROM p WHERE src = 1 GROUP BY ALL), f2 AS (SELECT part, name, count(*) AS n FROM p WHERE src > 1 GROUP BY ALL),
fa AS (SELECT part, house, street, count(*) AS n FROM p WHERE src = 1 GROUP BY ALL), pr AS (SELECT part, name, l.id AS l_id, r.id AS r_id, l.house AS lh, l.street AS ls, r.house AS rh, r.street AS rs
  FROM p l JOIN p r USING (part, name) WHERE l.src = 1 AND r.src > 1)
SELECT l_id, r_id, f1.n AS cnt_key_s1, f2.n AS cnt_key_rec, a.n AS l_cnt_addr, coalesce(b.n, 0) AS r_cnt_addr
FROM pr JOIN f1 USING (part, name) JOIN f2 USING (part, name) JOIN fa a ON a.part = pr.part AND a.house = lh AND a.street = ls LEFT JOIN fa b ON b.part = pr.part AND b.house = rh AND b.street = rs""",
)
def freq_tables(spark, sf_dir):
    """How common a pair's keys are: frequency tables attached to both sides."""
    p = parts(spark, sf_dir)
    e, r = p.filter("src = 1"), p.filter("src > 1")
    f1 = e.groupBy("part", "name").agg(F.count("*").alias("cnt_key_s1"))
    f2 = r.groupBy("part", "name").agg(F.count("*").alias("cnt_key_rec"))
    fa = e.groupBy("part", "house", "street").agg(F.count("*").alias("n"))
    d = part_pairs(spark, sf_dir).join(f1, ["part", "name"], "left").join(f2, ["part", "name"], "left")
    for x in "lr":
        f = fa.select("part", F.col("house").alias(f"{x}_house"), F.col("street").alias(f"{x}_street"), F.col("n").alias(f"{x}_cnt_addr"))
        d = d.join(f, ["part", f"{x}_house", f"{x}_street"], "left")
    return d.na.fill(0, ["l_cnt_addr", "r_cnt_addr"]).select("l_id", "r_id", "cnt_key_s1", "cnt_key_rec", "l_cnt_addr", "r_cnt_addr")


@query(
    "global_idf",
    """WITH d AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark),
t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}'))) AS term FROM d), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT term, df, round(least(ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (df + 1)), 12), 6) AS idf FROM df WHERE df >= 5""",
)
def global_idf(spark, sf_dir):
    """One rarity table over all sources: never one per split or country."""
    both = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "benchmark").select("text"))
    n = both.agg(F.count("*").alias("n"))
    df = both.select(F.explode(F.array_distinct(E.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter("df >= 5")
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.least(F.log((F.col("n") + 1) / (F.col("df") + 1)), F.lit(12.0)), 6).alias("idf"))


@query(
    "capped_doc_frequency",
    f"""WITH {SQL_PARTS}, t AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS term FROM p), df AS (SELECT term, least(count(*), 100) AS df FROM t GROUP BY 1),
x AS (SELECT l.id AS l_id, r.id AS r_id, list_filter(string_split(r.name, ' '), lambda w: NOT list_contains(string_split(l.name, ' '), w)) AS extra FROM p l JOIN p r ON l.part = r.part AND l.house = r.house AND l.street = r.street WHERE l.src = 1 AND r.src > 1),
y AS (SELECT l_id, r_id, unnest(extra) AS term FROM x)
SELECT x.l_id, x.r_id, coalesce(min(df.df), -1) AS dfmin_unshared FROM x LEFT JOIN y ON x.l_id = y.l_id AND x.r_id = y.r_id LEFT JOIN df USING (term) GROUP BY 1, 2""",
)
def capped_doc_frequency(spark, sf_dir):
    """The rarest word that only the record's name has, as a document frequency clipped at 100; -1 without one."""
    p = parts(spark, sf_dir)
    df = p.select("id", F.explode(F.array_distinct(F.split("name", " "))).alias("term")).groupBy("term").agg(F.least(F.count("*"), F.lit(100)).alias("df"))
    pairs = part_pairs(spark, sf_dir, ("part", "house", "street"))
    extra = pairs.select("l_id", "r_id", F.explode_outer(F.array_except(F.split("r_name", " "), F.split("l_name", " "))).alias("term"))
    return extra.join(df, "term", "left").groupBy("l_id", "r_id").agg(F.coalesce(F.min("df"), F.lit(-1)).cast("long").alias("dfmin_unshared"))


@query(
    "acronym_match",
    f"""WITH {SQL_PARTS}, a AS (SELECT id, src, part, name, array_to_string(list_transform(string_split(name, ' '), lambda w: w[1]), '') AS acr, replace(name, ' ', '') AS compact FROM p)
SELECT l.id AS l_id, r.id AS r_id, CAST(l.acr = r.compact OR r.acr = l.compact AS INT) AS acr_match, CAST(l.acr = r.acr AS INT) AS same_acr, round(length(r.name) / greatest(length(l.name), 1), 6) AS len_ratio
FROM a l JOIN a r ON l.part = r.part AND l.acr = r.acr WHERE l.src = 1 AND r.src > 1""",
)
def acronym_match(spark, sf_dir):
    """Initials against compact names, and length ratios, for pairs of equal initials."""
    p = parts(spark, sf_dir)
    words = F.split("name", " ")
    a = p.select("id", "src", "part", "name", F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("acr"), F.replace("name", F.lit(" "), F.lit("")).alias("compact"))
    l, r = (a.filter(c).withColumnsRenamed({k: f"{x}_{k}" for k in ("id", "name", "compact", "src")}) for c, x in (("src = 1", "l"), ("src > 1", "r")))
    return l.join(r, ["part", "acr"]).select(
        "l_id", "r_id", ((F.col("acr") == F.col("r_compact")) | (F.col("acr") == F.col("l_compact"))).cast("int").alias("acr_match"),
        F.lit(1).alias("same_acr"), F.round(F.length("r_name") / F.greatest(F.length("l_name"), F.lit(1)), 6).alias("len_ratio"),
    )


@query(
    "coref_context",
    """
WITH c AS (SELECT l_orderkey AS s1, l_linenumber AS line, l_partkey AS rid, l_suppkey % 2 AS src, l_quantity / 50 AS p FROM lineitem),
j AS (SELECT a.s1, a.line, a.rid, b.p AS op, CAST(a.src = b.src AS INT) AS same FROM c a JOIN c b ON a.s1 = b.s1 AND NOT (a.line = b.line AND a.rid = b.rid) WHERE a.p BETWEEN 0.005 AND 0.995 AND b.p >= 0.5)
SELECT s1, line, rid, count(*) AS co_n, max(op) AS co_max, min(op) AS co_min, max(CASE WHEN same = 1 THEN op END) AS co_same_src, max(same) AS any_same FROM j GROUP BY 1, 2, 3""",
)
def coref_context(spark, sf_dir):
    """An uncertain candidate beside the other confident candidates of its entity."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("s1"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("rid"), (F.col("l_suppkey") % 2).alias("src"), (F.col("l_quantity") / 50).alias("p")
    )
    j = J.rivals(c, ["s1"], ["line", "rid"], F.col("p") >= 0.5).filter("p BETWEEN 0.005 AND 0.995")
    same = F.col("src") == F.col("other_src")
    return j.groupBy("s1", "line", "rid").agg(
        F.count("*").alias("co_n"), F.max("other_p").alias("co_max"), F.min("other_p").alias("co_min"),
        F.max(F.when(same, F.col("other_p"))).alias("co_same_src"), F.max(same.cast("int")).alias("any_same"),
    )


@query(
    "second_best_other_source",
    """
WITH c AS (SELECT l_orderkey AS s1, 2 + l_suppkey % 2 AS src, l_linenumber AS line, l_partkey AS rid, l_extendedprice AS p FROM lineitem),
t AS (SELECT s1, src, list(p ORDER BY p DESC)[1:2] AS top FROM c GROUP BY ALL)
SELECT c.s1, c.src, c.line, c.rid, t.top[1] AS other_best, t.top[2] AS other_second FROM c LEFT JOIN t ON t.s1 = c.s1 AND t.src = 5 - c.src""",
)
def second_best_other_source(spark, sf_dir):
    """The two best scores that the entity has in the other source, by the derived key 5 - src."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("s1"), (2 + F.col("l_suppkey") % 2).alias("src"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("rid"), F.col("l_extendedprice").alias("p")
    )
    best = G.best_in_group(c, ["s1", "src"], "p", "line", "rid", k=2)
    top = best.groupBy("s1", (5 - F.col("src")).alias("src")).agg(F.max("p").alias("other_best"), F.when(F.count("*") > 1, F.min("p")).alias("other_second"))
    return c.drop("p").join(top, ["s1", "src"], "left")


_LINK = """u AS (SELECT o_orderkey AS s1, o_custkey % 5 AS country FROM orders),
truth AS (SELECT DISTINCT l_orderkey AS s1, CAST(2 + l_suppkey % 2 AS BIGINT) AS src, l_partkey AS rid FROM lineitem WHERE l_quantity >= 20),
pred AS (SELECT DISTINCT l_orderkey AS s1, CAST(2 + l_suppkey % 2 AS BIGINT) AS src, l_partkey + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS rid FROM lineitem WHERE l_discount <= 0.05),
cand AS (SELECT DISTINCT l_orderkey AS s1, CAST(2 + l_suppkey % 2 AS BIGINT) AS src, l_partkey AS rid FROM lineitem WHERE l_discount <= 0.08)"""
_ENT = (
    _LINK
    + """,
nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1), np AS (SELECT s1, count(*) AS n_pred FROM pred GROUP BY 1), tp AS (SELECT s1, count(*) AS tp FROM pred JOIN truth USING (s1, src, rid) GROUP BY 1),
pe AS (SELECT u.s1, u.country, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM u LEFT JOIN nt USING (s1) LEFT JOIN np USING (s1) LEFT JOIN tp USING (s1)),
sc AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END AS f FROM pe)"""
)


def _linkage(spark, sf_dir):
    """A made-up linkage: orders as entities, lines as records; truth, prediction and candidates differ by quantity, discount, tax."""
    li = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_orderkey").alias("s1"), (2 + F.col("l_suppkey") % 2).alias("src"), F.col("l_partkey").alias("rid")]
    off = (F.col("l_partkey") + F.when(F.col("l_tax") > 0.07, 1).otherwise(0)).alias("rid")
    universe = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), (F.col("o_custkey") % 5).alias("country"))
    truth = li.filter("l_quantity >= 20").select(*pair)
    pred = li.filter("l_discount <= 0.05").select(*pair[:2], off)
    return universe, truth, pred, li.filter("l_discount <= 0.08").select(*pair)


def _scores(spark, sf_dir):
    universe, truth, pred, _ = _linkage(spark, sf_dir)
    return D.per_entity(pred, truth, universe, "s1", ["src", "rid"]).join(universe, "s1")


@query("metric_per_entity", f"WITH {_ENT} SELECT s1, n_true, n_pred, tp, round(f, 9) AS f FROM sc")
def metric_per_entity(spark, sf_dir):
    """F0.5 of every entity, those with nothing to find or nothing found included."""
    return _scores(spark, sf_dir).select("s1", "n_true", "n_pred", "tp", F.round("f", 9).alias("f"))


@query("macro_f05", f"WITH {_ENT} SELECT count(*) AS n, round(avg(f), 9) AS macro_f FROM sc")
def macro_f05(spark, sf_dir):
    universe, truth, pred, _ = _linkage(spark, sf_dir)
    return M.macro(pred, truth, universe, "s1", ["src", "rid"]).select("n", F.round("macro_f", 9).alias("macro_f"))


@query(
    "metric_breakdown",
    f"""WITH {_ENT} SELECT country, size, count(*) AS n, round(avg(f), 9) AS f FROM (SELECT *, CASE WHEN n_true >= 3 THEN '3+' ELSE CAST(n_true AS VARCHAR) END AS size FROM sc)
GROUP BY GROUPING SETS ((country, size), (country), (size), ())""",
)
def metric_breakdown(spark, sf_dir):
    """In total, by country, by size, and by both."""
    return M.breakdown(_scores(spark, sf_dir), "country").select("country", "size", "n", F.round("f", 9).alias("f"))


@query(
    "metric_by_source",
    f"""WITH {_LINK} SELECT src, n_pred, n_true, tp, round(tp / greatest(n_pred, 1), 9) AS precision, round(tp / greatest(n_true, 1), 9) AS recall FROM (
SELECT src, sum(p) AS n_pred, sum(t) AS n_true, sum(p * t) AS tp FROM (SELECT s1, src, rid, max(p)::BIGINT AS p, max(t)::BIGINT AS t FROM (SELECT *, 1 AS p, 0 AS t FROM pred UNION ALL SELECT *, 0, 1 FROM truth) GROUP BY ALL) GROUP BY src)""",
)
def metric_by_source(spark, sf_dir):
    """Pair precision and recall of each source."""
    _, truth, pred, _ = _linkage(spark, sf_dir)
    d = M.by_source(pred, truth, "s1", "src", ["rid"])
    return d.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(
    "error_types",
    f"""WITH {_LINK}, fp AS (SELECT * FROM pred ANTI JOIN truth USING (s1, src, rid)), fn AS (SELECT * FROM truth ANTI JOIN pred USING (s1, src, rid)),
o AS (SELECT DISTINCT src, rid FROM truth), e AS (SELECT CASE WHEN o.rid IS NULL THEN 'fp_distractor' ELSE 'fp_wrong_entity' END AS error FROM fp LEFT JOIN o USING (src, rid)
UNION ALL SELECT CASE WHEN c.rid IS NULL THEN 'fn_blocking_miss' ELSE 'fn_model_miss' END FROM fn LEFT JOIN cand c USING (s1, src, rid)) SELECT error, count(*) AS n FROM e GROUP BY 1""",
)
def error_types(spark, sf_dir):
    """What kind of mistakes a linkage makes."""
    _, truth, pred, cand = _linkage(spark, sf_dir)
    return M.error_types(pred, truth, cand, "s1", ["src", "rid"])


_PROBS = """pb AS (SELECT l_orderkey AS s1, l_linenumber AS line, l_partkey AS rid, round(l_quantity / 51, 6) AS p FROM lineitem)"""


def _probabilities(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("s1"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("rid"), F.round(F.col("l_quantity") / 51, 6).alias("p"))


@query("expected_f_select")
def expected_f_select(spark, sf_dir):
    """For each entity the subset of greatest expected F0.5; held against a direct enumeration in tests."""
    return D.select_expected_f(_probabilities(spark, sf_dir), "p", ["s1"], "line", "rid").select("s1", "line", "rid")


@query(
    "threshold_sweep",
    f"""WITH {_PROBS}, truth AS (SELECT l_orderkey AS s1, l_partkey AS rid FROM lineitem WHERE l_discount <= 0.05 GROUP BY ALL), u AS (SELECT o_orderkey AS s1 FROM orders),
t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), pr AS (SELECT DISTINCT threshold, s1, rid FROM pb, t WHERE p >= threshold),
nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1), np AS (SELECT threshold, s1, count(*) AS n_pred FROM pr GROUP BY ALL), tp AS (SELECT threshold, s1, count(*) AS tp FROM pr JOIN truth USING (s1, rid) GROUP BY ALL)
SELECT threshold, count(*) AS n, round(avg(CASE WHEN coalesce(n_true, 0) = 0 AND coalesce(n_pred, 0) = 0 THEN 1 ELSE 1.25::DOUBLE * coalesce(tp, 0) / (0.25::DOUBLE * coalesce(n_true, 0) + coalesce(n_pred, 0)) END), 9) AS macro_f
FROM (SELECT * FROM u, t) x LEFT JOIN nt USING (s1) LEFT JOIN np USING (threshold, s1) LEFT JOIN tp USING (threshold, s1) GROUP BY threshold""",
)
def threshold_sweep(spark, sf_dir):
    """Macro F0.5 at several thresholds, in one job."""
    grid = [0.3, 0.5, 0.7]
    truth = table(spark, sf_dir, "lineitem").filter("l_discount <= 0.05").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("rid"))
    universe = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"))
    pred = D.sweep_thresholds(_probabilities(spark, sf_dir), "p", grid)
    each = D.per_entity(pred, truth, universe, "s1", ["rid"], ("threshold", grid))
    return each.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("f"), 9).alias("macro_f"))


@query(
    "logit_shift",
    f"""WITH {_PROBS}, q AS (SELECT *, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p)) AS c FROM pb)
SELECT s1, line, rid, round(1 / (1 + exp(-(ln(c / (1 - c)) - 0.65::DOUBLE))), 9) AS shifted FROM q""",
)
def logit_shift(spark, sf_dir):
    """Probabilities moved on the logit scale."""
    return _probabilities(spark, sf_dir).select("s1", "line", "rid", F.round(E.logit_shift(F.col("p"), -0.65), 9).alias("shifted"))


@query(
    "blend_full_outer",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey, o_totalprice / 2 AS p FROM orders WHERE o_orderstatus <> 'O')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, round((coalesce(a.p, 0) + coalesce(b.p, 0)) / ((a.p IS NOT NULL)::INT + (b.p IS NOT NULL)::INT), 6) AS p FROM a FULL JOIN b USING (o_orderkey)""",
)
def blend_full_outer(spark, sf_dir):
    """Two scorings averaged where both know a pair, else as the one has it."""
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_totalprice").alias("p"))
    b = o.filter("o_orderstatus <> 'O'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("p"))
    return J.blended(a, b, ["o_orderkey"], "p").withColumn("p", F.round("p", 6))


@query(
    "list_output",
    "SELECT c_custkey, coalesce(string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def list_output(spark, sf_dir):
    """One row per entity with its sorted ids as text, empty where there is none."""
    from millrace.sources.linkage import id_lists

    entities = table(spark, sf_dir, "customer").select("c_custkey")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("id"))
    return id_lists(entities, pairs, "c_custkey", "id", "ids")


@query(
    "list_diff",
    """WITH a AS (SELECT o_custkey, list(o_orderkey) AS x FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey, list(o_orderkey) AS y FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
j AS (SELECT coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (o_custkey))
SELECT count(*) AS n, count(*) FILTER (len(list_intersect(x, y)) = len(x) AND len(x) = len(y)) AS same, sum(len(list_intersect(x, y)))::BIGINT AS shared, sum(len(x) - len(list_intersect(x, y)))::BIGINT AS only_first, sum(len(y) - len(list_intersect(x, y)))::BIGINT AS only_second FROM j""",
)
def list_diff(spark, sf_dir):
    """Two outputs compared list by list."""
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("x"))
    b = o.filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("y"))
    none = F.array().cast("array<bigint>")
    j = a.join(b, "o_custkey", "full").select(F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return j.agg(
        F.count("*").alias("n"), F.count_if((shared == F.size("x")) & (F.size("x") == F.size("y"))).alias("same"), F.sum(shared).alias("shared"),
        F.sum(F.size(F.array_except("x", "y"))).alias("only_first"), F.sum(F.size(F.array_except("y", "x"))).alias("only_second"),
    )


@query(
    "output_contract",
    """WITH c AS (SELECT o_custkey, list(o_orderkey) AS cand FROM orders GROUP BY 1), m AS (SELECT o_custkey, list(o_orderkey) AS got FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT 'missing entity' AS problem, (SELECT count(*) FROM customer ANTI JOIN m ON m.o_custkey = c_custkey) AS n UNION ALL
SELECT 'unknown entity', (SELECT count(*) FROM m ANTI JOIN customer ON m.o_custkey = c_custkey) UNION ALL SELECT 'repeated id', (SELECT count(*) FROM m WHERE len(list_distinct(got)) < len(got)) UNION ALL
SELECT 'not a candidate', (SELECT count(*) FROM m LEFT JOIN c USING (o_custkey) WHERE len(list_intersect(got, coalesce(cand, []))) < len(list_distinct(got)))""",
)
def output_contract(spark, sf_dir):
    """How many rows of an output break each of its rules."""
    from millrace.sources.linkage import contract_violations

    o = table(spark, sf_dir, "orders")
    cand = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("ids"))
    got = o.filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("ids"))
    return contract_violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), got, cand)


@query(
    "densify_sample",
)
def densify_sample(spark, sf_dir):
    """A universe with more distractors: a hash-drawn share of the records that nobody owns is copied, marked by origin."""
    from millrace.operators.synthetic import densify

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return densify(o, o.filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 1.63, seed=2026)


@query(
    "field_coverage",
    f"""{_PAIRS} SELECT field, count(*) AS n, sum(eq)::BIGINT AS equal FROM (SELECT unnest([{{'f': 'house', 'e': (l_house = r_house)::INT}}, {{'f': 'street', 'e': (l_street = r_street)::INT}}]) AS x FROM pr) t, LATERAL (SELECT x.f AS field, x.e AS eq) GROUP BY 1""",
)
def field_coverage(spark, sf_dir):
    """How often each field agrees over true pairs: fields unpivoted, one aggregation."""
    d = part_pairs(spark, sf_dir).select((F.col("l_house") == F.col("r_house")).cast("int").alias("house"), (F.col("l_street") == F.col("r_street")).cast("int").alias("street"))
    return d.unpivot([], ["house", "street"], "field", "eq").groupBy("field").agg(F.count("*").alias("n"), F.sum("eq").alias("equal"))


@query(
    "score_quantiles",
    "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, count(DISTINCT o_custkey) AS customers, round(avg((o_totalprice > 100000)::INT), 9) AS share FROM orders GROUP BY 1",
)
def score_quantiles(spark, sf_dir):
    """Exact quantiles, distinct counts and shares by group."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"),
        F.countDistinct("o_custkey").alias("customers"), F.round(F.avg((F.col("o_totalprice") > 100000).cast("int")), 9).alias("share"),
    )


@query(
    "sibling_clusters",
    f"""WITH {SQL_PARTS}, g AS (SELECT part, name, street, count(*) AS n, count(DISTINCT src) AS n_src FROM p GROUP BY ALL)
SELECT part, count(*) AS clusters, sum(n)::BIGINT AS members FROM g WHERE n >= 2 AND n_src = 2 GROUP BY 1""",
)
def sibling_clusters(spark, sf_dir):
    """Groups that repeat a name and street in exactly two sources."""
    g = parts(spark, sf_dir).groupBy("part", "name", "street").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src")).filter("n >= 2 AND n_src = 2")
    return g.groupBy("part").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"))


@query(
    "embedding_cosine_topk",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cos
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, other) AS rk FROM s)
SELECT vec_id, other, cos, rk::BIGINT AS rk FROM t WHERE rk <= 3""",
)
def embedding_cosine_topk(spark, sf_dir):
    """For each vector of an entity its three nearest records of the same label, by cosine of pairs in a label."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    e = e.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    a = e.filter("vec_id % 3 = 0").select("vec_id", "label", F.col("v").alias("a"), F.col("norm").alias("na"))
    b = e.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("other"), "label", F.col("v").alias("b"), F.col("norm").alias("nb"))
    s = a.join(b, "label").select("vec_id", "other", F.round(dot(F.col("a"), F.col("b")) / (F.col("na") * F.col("nb")), 6).alias("cos"))
    top = G.best_in_group(s, ["vec_id"], "cos", "other", k=3, rank="rk")
    return top.withColumn("rk", F.col("rk").cast("long"))
