"""Text functions, similarity kernels, mining and token features over the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions import similarity as S
from millrace.operators import features as X
from millrace.operators import mining as MN
from millrace.operators.joins import capped_key_join, expanded, null_safe
from millrace.plans.registry import query
from millrace.plans.roles import SQL_PARTS, part_pairs, parts, table


@query(
    "url_domain",
    r"""SELECT page_id, regexp_extract(lower(url), '(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*)\.(?:com|net|org)', 1) AS domain,
  regexp_matches(lower(url), '://www\.') AS www FROM pages WHERE url IS NOT NULL""",
)
def url_domain(spark, sf_dir):
    """The domain that a web address names."""
    url = F.lower("url")
    pattern = r"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*)\.(?:com|net|org)"
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", F.regexp_extract(url, pattern, 1).alias("domain"), url.rlike(r"://www\.").alias("www"))


@query(
    "id_tokens",
    """SELECT page_id, array_to_string(list_sort(list_transform(list_distinct(regexp_extract_all(lower(replace(replace(coalesce(url, ''), '/', ''), '.', ' ')),
  '[a-z]+[0-9]+[a-z0-9]*|[0-9]+[a-z]+[a-z0-9]*')), lambda x: '#' || x)), ' ') AS ids FROM pages""",
)
def id_tokens(spark, sf_dir):
    """Tokens of letters and digits together, out of addresses without slashes."""
    text = F.translate(F.coalesce("url", F.lit("")), "./", " ")
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+[0-9]+[a-z0-9]*|[0-9]+[a-z]+[a-z0-9]*"), F.lit(0))
    ids = F.array_join(F.array_sort(F.transform(F.array_distinct(found), lambda x: F.concat(F.lit("#"), x))), " ")
    return table(spark, sf_dir, "pages").select("page_id", ids.alias("ids"))


@query("fold_accents", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents WHERE lang IN ('fr', 'es', 'de') AND text IS NOT NULL AND NOT regexp_matches(text, '[ßøæœ’‘–—]')")
def fold_accents(spark, sf_dir):
    """Lower case without accents."""
    d = table(spark, sf_dir, "documents").filter("lang IN ('fr', 'es', 'de') AND text IS NOT NULL").filter(~F.col("text").rlike("[ßøæœ’‘–—]"))
    return d.select("doc_id", F.md5(N.folded()("text")).alias("folded"))


@query("nonlatin_flags", "SELECT lang, count(*) AS n, sum((regexp_matches(coalesce(text, ''), '[ऀ-෿]'))::INT)::BIGINT AS indic, sum((regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]'))::INT)::BIGINT AS non_ascii FROM documents GROUP BY 1")
def nonlatin_flags(spark, sf_dir):
    """Texts with characters of Indian scripts, and with any beyond ASCII."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(text.rlike("[ऀ-෿]").cast("int")).alias("indic"), F.sum(text.rlike(r"[^\x00-\x7F]").cast("int")).alias("non_ascii")
    )


@query(
    "name_key",
    f"WITH {SQL_PARTS} SELECT id, name AS n_core, array_to_string(list_sort(list_distinct(string_split(name, ' '))), ' ') AS n_key, array_to_string(list_transform(string_split(name, ' '), lambda w: w[1]), '') AS n_acr, '' AS n_legal FROM p",
)
def name_key(spark, sf_dir):
    """Name views of part names: core, key, initials, legal form."""
    p = parts(spark, sf_dir).withColumn("v", N.name_views_udf()("name"))
    return p.select("id", "v.n_core", "v.n_key", "v.n_acr", "v.n_legal")


@query("name_views")
def name_views(spark, sf_dir):
    """All eleven name views, of part names under a honorific, an alias, a web address and a legal form by turns."""
    p = parts(spark, sf_dir)
    k = F.col("id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("Mr "), "name", F.lit(" L.L.C.")))
        .when(k == 1, F.concat("street", F.lit(" dba "), "name", F.lit(" & Sons")))
        .when(k == 2, F.concat("name", F.lit(" | www."), F.replace("name", F.lit(" "), F.lit("")), F.lit(".com")))
        .otherwise(F.concat(F.lit("Société "), F.upper("name")))
    )
    return p.select("id", raw.alias("raw"), N.name_views_udf()(raw).alias("v")).select("id", "raw", "v.*")


@query("address_views")
def address_views(spark, sf_dir):
    """All twelve address views, of addresses made from part's house, name and brand."""
    p = parts(spark, sf_dir)
    raw = F.concat("house", F.lit(" "), "name", F.when(F.col("id") % 2 == 0, " Street, Unit 4, ").otherwise(" ave, "), F.translate("street", "#0123456789", ""), F.lit(" city, 75001"))
    return p.select("id", raw.alias("raw"), N.address_views_udf()(raw, F.lit("US")).alias("v")).select("id", "raw", "v.*")


_FUZZY = f"""WITH {SQL_PARTS}, pr AS (SELECT l.id AS l_id, r.id AS r_id, l.name AS l_name, r.name AS r_name FROM p l JOIN p r ON l.part = r.part AND l.street = r.street WHERE l.src = 1 AND r.src > 1)"""


def _street_pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir, ("part", "street"))


def _street_names(spark, sf_dir):
    """(part, street, l_name, r_name): the different names of a part and street's entities and records, and their rows."""
    p, block = parts(spark, sf_dir), ["part", "street"]
    e, r = (p.filter(c).select(*block, F.col("name").alias(f"{x}_name"), F.col("id").alias(f"{x}_id")) for c, x in (("src = 1", "l"), ("src > 1", "r")))
    return e.drop("l_id").distinct().join(r.drop("r_id").distinct(), block), e, r


def _by_name(spark, sf_dir, compared):
    """(l_id, r_id, ...) of all street pairs; compared (l_name, r_name) -> (l_name, r_name, ...) works each two names out once."""
    block_names, e, r = _street_names(spark, sf_dir)
    each = null_safe(block_names, compared(block_names.select("l_name", "r_name").distinct()), ["l_name", "r_name"])
    return expanded(each, e, r, ["part", "street"], ["l_name"], ["r_name"])


@query("jaro_winkler_pairs", f"{_FUZZY} SELECT l_id, r_id, round(jaro_winkler_similarity(l_name, r_name), 9) AS jw FROM pr")
def jaro_winkler_pairs(spark, sf_dir):
    return _street_pairs(spark, sf_dir).select("l_id", "r_id", F.round(S.pairwise(S.jaro_winkler)("l_name", "r_name"), 9).alias("jw"))


@query(
    "edit_distance_pairs",
    f"{_FUZZY} SELECT l_id, r_id, levenshtein(l_name, r_name)::BIGINT AS lev, (levenshtein(l_name, r_name) = 1)::INT AS one_edit FROM pr",
)
def edit_distance_pairs(spark, sf_dir):
    d = F.levenshtein("l_name", "r_name")
    return _street_pairs(spark, sf_dir).select("l_id", "r_id", d.cast("long").alias("lev"), (F.levenshtein("l_name", "r_name", 1) == 1).cast("int").alias("one_edit"))


@query("fuzzy_ratios")
def fuzzy_ratios(spark, sf_dir):
    """The four Indel ratios of names, null where a name is empty."""
    kernels = [S.masked(S.pairwise(S.KERNELS[k])("l_name", "r_name"), F.col("l_name"), F.col("r_name")).alias(k) for k in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")]
    d = _by_name(spark, sf_dir, lambda names: names.repartition("l_name", "r_name").select("l_name", "r_name", *kernels))
    return d.select("l_id", "r_id", "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")


@query("monge_elkan_pairs")
def monge_elkan_pairs(spark, sf_dir):
    """Best token matches in both directions."""
    kind = "struct<me_l:double,me_min:double,me_r:double,n_low:int,worst:string>"
    names = ["me_l", "me_min", "me_r", "n_low", "worst"]

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [S.monge_elkan(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        fields = [("me_l", pa.float64()), ("me_min", pa.float64()), ("me_r", pa.float64()), ("n_low", pa.int32()), ("worst", pa.string())]
        return pa.array([dict(zip(names, r, strict=True)) if r else None for r in rows], pa.struct(fields))

    d = _by_name(spark, sf_dir, lambda pairs: pairs.repartition("l_name", "r_name").select("l_name", "r_name", run("l_name", "r_name").alias("m")))
    return d.select("l_id", "r_id", "m.*")


@query(
    "weighted_token_overlap",
    f"""{_FUZZY}, n AS (SELECT count(*) AS n FROM p), t AS (SELECT unnest(list_distinct(string_split(name, ' '))) AS token FROM p),
i AS (SELECT token, least(ln((n + 1)::DOUBLE / (count(*) + 1)), 12) AS w FROM t, n GROUP BY token, n),
x AS (SELECT l_id, r_id, string_split(l_name, ' ') AS l, string_split(r_name, ' ') AS r FROM pr),
e AS (SELECT l_id, r_id, l, r, unnest(list_distinct(l || r)) AS token FROM x),
f AS (SELECT l_id, r_id, w, list_contains(l, token) AS inl, list_contains(r, token) AS inr FROM e JOIN i USING (token))
SELECT l_id, r_id, round(sum(w) FILTER (inl AND inr) / sum(w), 6) AS wjac, round(sum(w) FILTER (inl AND inr) / sum(w) FILTER (inl), 6) AS cont_l,
  round(sum(w) FILTER (inl AND inr) / sum(w) FILTER (inr), 6) AS cont_r, round(coalesce(max(w) FILTER (inl AND NOT inr), 0), 6) AS unsh_l, round(coalesce(max(w) FILTER (inr AND NOT inl), 0), 6) AS unsh_r
FROM f GROUP BY 1, 2""".replace("sum(w) FILTER (inl AND inr)", "coalesce(sum(w) FILTER (inl AND inr), 0)"),
)
def weighted_token_overlap(spark, sf_dir):
    """Rarity-weighted Jaccard, containments and rarest unshared tokens of names."""
    idf = X.rarity(parts(spark, sf_dir).select(F.split("name", " ").alias("t")), "t")
    kept = ("wjac", "cont_l", "cont_r", "unsh_l", "unsh_r")
    keys = ["l_name", "r_name"]

    def overlap(names):
        words = names.select(*keys, F.split("l_name", " ").alias("l"), F.split("r_name", " ").alias("r"))
        return X.weighted_overlap(words, keys, "l", "r", idf).select(*keys, *[F.round(c, 6).alias(c) for c in kept])

    return _by_name(spark, sf_dir, overlap).select("l_id", "r_id", *kept)


@query(
    "number_set_overlap",
    """WITH d AS (SELECT doc_id, lang, source, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS x FROM documents),
j AS (SELECT a.doc_id, b.doc_id AS other, a.x AS x, b.x AS y FROM d a JOIN d b ON a.lang = b.lang AND a.source = b.source AND a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0)
SELECT doc_id, other, len(x)::BIGINT AS nl, len(y)::BIGINT AS nr, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) END AS jac,
  CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / len(x), 6) END AS cont_l FROM j""",
)
def number_set_overlap(spark, sf_dir):
    """Sets of numbers in texts of one language and source."""
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", numbers.alias("x"))
    b = d.filter("doc_id % 3 <> 0").withColumnsRenamed({"doc_id": "other", "x": "y"})
    j = d.filter("doc_id % 3 = 0").join(b, ["lang", "source"]).withColumn("o", X.set_overlap(F.col("x"), F.col("y")))
    return j.select("doc_id", "other", F.size("x").cast("long").alias("nl"), F.size("y").cast("long").alias("nr"), F.round("o.jac", 6).alias("jac"), F.round("o.cont_l", 6).alias("cont_l"))


@query("name_vocabulary", f"WITH {SQL_PARTS}, t AS (SELECT unnest(string_split(name, ' ')) AS token FROM p) SELECT token, count(*) AS n FROM t WHERE regexp_full_match(token, '[a-z]+') GROUP BY 1 HAVING count(*) >= 3")
def name_vocabulary(spark, sf_dir):
    return MN.vocabulary(parts(spark, sf_dir).select(F.split("name", " ").alias("t")), "t")


_TRUE = f"""WITH {SQL_PARTS}, pr AS (SELECT l.id AS l_id, r.id AS r_id, string_split(l.name, ' ') AS l, string_split(r.name, ' ') AS r FROM p l JOIN p r ON l.part = r.part AND l.house = r.house AND l.street = r.street WHERE l.src = 1 AND r.src > 1)"""


def _true_pairs(spark, sf_dir):
    return part_pairs(spark, sf_dir, ("part", "house", "street")).select("l_id", "r_id", F.split("l_name", " ").alias("l"), F.split("r_name", " ").alias("r"))


@query(
    "align_translit",
    f"""{_TRUE}, z AS (SELECT unnest(list_zip(l, r)) AS z FROM pr WHERE len(l) = len(r)), c AS (SELECT z[1] AS word, z[2] AS "to", count(*) AS n FROM z GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY word) AS share FROM c) SELECT word, "to", n, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, "to") = 1 AND n >= 2 AND share >= 0.3""",
)
def align_translit(spark, sf_dir):
    """Words aligned by place in linked names, and each one's most frequent counterpart."""
    return MN.alignments(_true_pairs(spark, sf_dir), "l", "r", 2, 0.3).withColumn("share", F.round("share", 6))


@query(
    "mine_synonyms",
    f"""{_TRUE}, o AS (SELECT list_distinct(list_filter(l, lambda x: NOT list_contains(r, x))) AS a, list_distinct(list_filter(r, lambda x: NOT list_contains(l, x))) AS b FROM pr),
e AS (SELECT unnest(a) AS word, b FROM o WHERE len(a) BETWEEN 1 AND 2 AND len(b) BETWEEN 1 AND 2), f AS (SELECT word, unnest(b) AS "to" FROM e), c AS (SELECT word, "to", count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY word) AS share FROM c) SELECT word, "to", n, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, "to") = 1 AND n >= 2 AND share >= 0.1""",
)
def mine_synonyms(spark, sf_dir):
    """Words that stand for each other where linked names differ in a word or two."""
    return MN.substitutions(_true_pairs(spark, sf_dir), "l", "r", 2, 0.1).withColumn("share", F.round("share", 6))


@query(
    "noise_vs_sibling",
    f"""{_TRUE}, la AS (SELECT string_split(l.name, ' ') AS l, string_split(r.name, ' ') AS r FROM p l JOIN p r ON l.part = r.part AND l.street = r.street AND l.house <> r.house WHERE l.src = 1 AND r.src > 1),
t AS (SELECT word, count(*) AS n_true FROM (SELECT unnest(list_distinct(list_filter(r, lambda x: NOT list_contains(l, x)))) AS word FROM pr) GROUP BY 1),
a AS (SELECT word, count(*) AS n_alike FROM (SELECT unnest(list_distinct(list_filter(r, lambda x: NOT list_contains(l, x)))) AS word FROM la) GROUP BY 1)
SELECT word, coalesce(n_true, 0) AS n_true, coalesce(n_alike, 0) AS n_alike,
  round(((coalesce(n_true, 0) + 1)::DOUBLE / ((SELECT count(*) FROM pr) + 1)) / ((coalesce(n_alike, 0) + 1)::DOUBLE / ((SELECT count(*) FROM la) + 1)), 6) AS rate
FROM t FULL JOIN a USING (word) WHERE coalesce(n_true, 0) + coalesce(n_alike, 0) >= 20""",
)
def noise_vs_sibling(spark, sf_dir):
    """Added words by how much likelier they are in true pairs than in look-alikes."""
    alike = part_pairs(spark, sf_dir, ("part", "street")).filter("l_house <> r_house").select(F.split("l_name", " ").alias("l"), F.split("r_name", " ").alias("r"))
    return MN.added_words(_true_pairs(spark, sf_dir), alike, "l", "r", 20).withColumn("rate", F.round("rate", 6))


@query(
    "state_discovery",
    """WITH c AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS c FROM pages WHERE url IS NOT NULL),
e AS (SELECT unnest(c) AS component, unnest(range(len(c))) AS pos, len(c) AS size FROM c)
SELECT component, count(*) FILTER (pos = size - 1) AS n, round(count(*) FILTER (pos = size - 1) / count(*), 6) AS share FROM e GROUP BY 1
HAVING count(*) FILTER (pos = size - 1) >= 5 AND count(*) FILTER (pos = size - 1) / count(*) >= 0.5 AND NOT regexp_matches(component, '[0-9]')""",
)
def state_discovery(spark, sf_dir):
    """Components that mostly come last: how states show in addresses, here the parts of web paths."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    d = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select(F.split(path, "/").alias("c"))
    return MN.final_components(d, "c", 5, 0.5).withColumn("share", F.round("share", 6))


@query(
    "exact_text_truth",
    "SELECT r.doc_id AS rid, min(e.doc_id) AS s1, count(*) AS n FROM documents r JOIN documents e ON r.lang = e.lang AND r.text = e.text WHERE r.doc_id % 3 <> 0 AND e.doc_id % 3 = 0 AND r.text <> '' GROUP BY 1 HAVING count(*) <= 20",
)
def exact_text_truth(spark, sf_dir):
    """Silver truth: each record's entity of equal text, by a capped key join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    e = d.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "s1")
    r = d.filter("doc_id % 3 <> 0").withColumnRenamed("doc_id", "rid")
    return capped_key_join(e, r, ["lang", "text"], 20).groupBy("rid").agg(F.min("s1").alias("s1"), F.count("*").alias("n"))
