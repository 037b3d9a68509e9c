"""URL filters: listed host rules, and association rules that Spark's FP-growth mines from labelled URLs.

Built-in functions only. The listed rules judge first; a URL that none fits gets the mined rules' verdict. A mined rule says
that URLs which hold all its tokens are to be blocked. It counts only if at least MIN_COUNT different labelled URLs hold them
and the share of bad ones among these is MIN_CONFIDENCE or more even SIGMAS standard deviations below what was seen; labels
that have nothing to do with URLs give no rule.

The number of frequent sets grows as 2 to the power of a basket's size, so baskets are made small first. Tokens of fewer
than MIN_COUNT URLs are in no rule. Tokens that the same labelled URLs hold are one item. A single item that makes a rule is
matched as such and leaves the baskets, as every larger set with it blocks nothing more. All this changes no verdict. Of what
is left, FP-growth sees the LARGEST most telling items of a URL. Sets that a bad URL of more items holds are searched level by
level over whole baskets, so no set is left out: only sets that no smaller one equals in its URLs, and that hold no rule, grow.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialise

#: Host (a trailing domain), path prefix, verdict.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
SIGMAS = 4.0
LARGEST = 14
#: ASCII letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; and the rest up to `?`, `#` or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def parse(pages: DataFrame) -> DataFrame:
    """pages with host and path; both are empty where the url is null or has no `://`."""
    host, path = host_and_path(F.coalesce(F.col("url").cast("string"), F.lit("")))
    return pages.withColumns({"host": host, "path": path})


def listed_rule(rules=LISTED) -> Column:
    """The name of the longest listed rule that fits host and path, else null; longest in characters, then host, then first."""
    found = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    for host, path, _ in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.lit(f"{host}{path}")).otherwise(found)
    return found


def _marked(kind: str):
    return lambda x: F.concat(F.lit(kind), x)


def tokens() -> Column:
    """The URL's distinct items: host labels as h:, path words as p:, the file ending as e:, query keys and pairs of key
    and value as q:, the fragment as f:. From host, path and url.

    But for host labels, digits are folded to 0, so page numbers don't make items of their own.
    """
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), r"[/._-]+"), lambda x: (x != "") & (x != "0"))
    after = F.regexp_replace(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)://[^/?#]*[^?#]*(.*)$", 1), "[0-9]+", "0")
    pairs = F.filter(F.split(F.regexp_extract(after, r"^\?([^#]*)", 1), "[&;]"), lambda x: x != "")
    keys = F.filter(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    ending = F.translate(F.regexp_extract(F.regexp_replace("path", "[0-9]+", "0"), r"[^/]\.([^./]+)$", 1), _UPPER, _LOWER)
    fragment = F.regexp_extract(after, r"(?s)#(.+)$", 1)
    named = (("h:", labels), ("p:", words), ("e:", F.array(ending)), ("q:", keys), ("q:", pairs), ("f:", F.array(fragment)))
    return F.array_distinct(F.concat(*[F.transform(F.filter(x, lambda y: y != ""), _marked(kind)) for kind, x in named]))


def _sure(bad: Column, n: Column, min_confidence: float) -> Column:
    """Wilson's lower bound of the share bad / n is min_confidence or more."""
    p, z = bad / n, SIGMAS
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return low >= min_confidence


def _least_bad(min_count: int, min_confidence: float) -> int:
    """How many bad URLs a rule has at least: Wilson's bound is greatest where all of them are bad, and then n / (n + SIGMAS^2)."""
    alone = math.ceil(min_confidence * SIGMAS**2 / (1 - min_confidence) - 1e-9) if min_confidence < 1 else 1
    return max(1, math.ceil(min_count * min_confidence), alone)


def _rest(baskets: DataFrame, least: int, min_count: int, min_confidence: float) -> DataFrame:
    """Rules (antecedent, n, bad) of two items or more among those that a long bad basket of baskets (row, bad, every, long) holds.

    Level by level: a set grows if `least` bad rows hold it, if it is no rule (a larger one blocks nothing more), and if each
    smaller set in it has more rows (of two sets with the same rows, the larger blocks nothing more).
    """
    rows = baskets.select("row", "bad", "every", (F.col("long") & (F.col("bad") == 1)).alias("long"))
    held = rows.select("row", F.explode("every").alias("x")).select("row", F.array("x").alias("set"))
    rules = None
    smaller = None
    while True:
        counts = held.join(rows.select("row", "bad", "long"), "row").groupBy("set").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.max("long").alias("long"))
        sets = counts.filter((F.col("bad") >= least) & F.col("long"))
        if smaller is not None:
            each = sets.select("set", "n", F.explode("set").alias("x")).select("set", "n", F.array_remove("set", F.col("x")).alias("less"))
            each = each.join(smaller.select(F.col("set").alias("less"), F.col("n").alias("more")), "less").filter("n < more")
            sets = sets.join(each.groupBy("set").agg(F.count("*").alias("k")).filter(F.col("k") == F.size("set")), "set", "left_semi")
        sure = (F.col("n") >= min_count) & _sure(F.col("bad"), F.col("n"), min_confidence)
        sets = materialise(sets.select("set", "n", "bad", sure.alias("rule")), "url-level")
        if smaller is not None:
            made = sets.filter("rule").select(F.col("set").alias("antecedent"), "n", "bad")
            rules = made if rules is None else rules.unionByName(made)
        smaller = sets.filter("NOT rule").select("set", "n")
        if smaller.limit(2).count() < 2:
            return rules if rules is not None else sets.filter("false").select(F.col("set").alias("antecedent"), "n", "bad")
        grown = held.join(smaller.select("set"), "set", "left_semi").join(rows.select("row", "every"), "row")
        grown = grown.select("row", "set", F.explode(F.filter("every", lambda x: x > F.element_at("set", -1))).alias("x"))
        held = materialise(grown.select("row", F.concat("set", F.array("x")).alias("set")), "url-holders")


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, largest: int = LARGEST) -> DataFrame:
    """Association rules (rule_id, antecedent, n, bad): n labelled URLs hold the antecedent, `bad` of them are bad.

    labelled has host, path, url and a Boolean `bad`; a URL counts once for each label. Of two rules the one whose antecedent
    contains the other's is of no account, as any fitting rule blocks. No rows, or only good ones, give no rule.
    """
    rows = labelled.select("host", "path", "url", "bad").distinct().select(F.xxhash64("url", "bad").alias("row"), F.col("bad").cast("long").alias("bad"), tokens().alias("tokens"))
    rows = materialise(rows, "url-rows")
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), "row").cast("decimal(38,0)"))
    items = held.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), wide(0).alias("a"), wide(1).alias("b")).filter(F.col("n") >= min_count)
    # tokens of the same rows are one item, named by the least of them
    items = items.groupBy("n", "bad", "a", "b").agg(F.min("token").alias("item"), F.sort_array(F.collect_set("token")).alias("members"))
    items = materialise(items.select("item", "members", "n", "bad", _sure(F.col("bad"), F.col("n"), min_confidence).alias("rule")), "url-items")
    single = items.filter("rule").select(F.array("item").alias("antecedent"), "n", "bad")
    told = held.join(items.filter("NOT rule").select(F.col("item").alias("token"), (F.col("bad") / F.col("n")).alias("share")), "token")
    best = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "token"))), 1, largest), lambda x: x["token"])
    every = F.sort_array(F.collect_list("token"))
    told = told.groupBy("row").agg(F.max("bad").alias("bad"), best.alias("items"), every.alias("every"))
    baskets = materialise(told.withColumn("long", F.size("every") > largest), "url-baskets")
    # a rule needs so many bad URLs at least, so the bad ones' baskets hold all sets that can make one
    ill = baskets.filter("bad = 1 AND size(every) > 1")
    n_bad = ill.count()
    least = _least_bad(min_count, min_confidence)
    if n_bad < least:
        rules = single
    else:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_bad, minConfidence=1.0).fit(ill)
        sets = model.freqItemsets.filter(F.size("items") > 1).select(F.sort_array("items").alias("antecedent"))
        sets = materialise(sets.withColumn("rule_id", F.xxhash64("antecedent")), "url-sets")
        found = match(rows.select("row", "bad", "tokens"), sets, "row").join(rows.select("row", "bad"), "row")
        counts = found.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).filter((F.col("n") >= min_count) & _sure(F.col("bad"), F.col("n"), min_confidence))
        rules = single.unionByName(sets.join(counts, "rule_id").select("antecedent", "n", "bad"))
        if baskets.filter("long AND bad = 1").limit(1).count():
            rules = rules.unionByName(_rest(baskets, least, min_count, min_confidence)).distinct()
    return materialise(rules.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "n", "bad"), "url-rules")


def match(parsed: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rule_id) of every rule whose antecedent a URL (key, tokens) holds, by an inverted index token -> rule.

    Each rule is indexed under its rarest token of the index alone, so common tokens have short lists;
    a join on the token then checks the whole antecedent.
    """
    posted = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    rarity = posted.groupBy("token").agg(F.count("*").alias("n"))
    index = (
        posted.join(rarity, "token")
        .groupBy("rule_id", "antecedent")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    )
    probes = parsed.select(key, "tokens", F.explode("tokens").alias("token"))
    hits = probes.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.select(key, "rule_id")


def judge(pages: DataFrame, labels: DataFrame, listed=LISTED, **mining) -> DataFrame:
    """pages with host, path, rule and verdict.

    labels has page_id and a Boolean `bad`. A listed rule gives the verdict; else `block` if a mined rule fits,
    else `allow`. Null urls have an empty host and path and no token, so they are allowed; repeated page_ids
    are judged each by its own url; empty labels mine no rule; other columns pass through, but for
    those of the result and _url, _hit, _id and bad. Very long urls are read whole; those that many rows share are matched once.
    """
    parsed = parse(pages.drop("host", "path", "rule", "verdict", "_url", "_hit", "_id", "bad"))
    marks = labels.select(F.col("page_id").alias("_id"), F.col("bad").cast("boolean").alias("bad")).filter("bad IS NOT NULL")
    labelled = parsed.join(marks, F.col("page_id") == F.col("_id")).select("host", "path", "url", "bad")
    rules = mine(labelled, **mining)
    keyed = parsed.withColumn("_url", F.xxhash64("url"))
    blocked = match(keyed.filter(listed_rule(listed).isNull()).select("_url", "host", "path", "url").distinct().select("_url", tokens().alias("tokens")), rules, "_url")
    blocked = blocked.select(F.col("_url").alias("_hit")).distinct()
    d = keyed.join(blocked, F.col("_url") == F.col("_hit"), "left").withColumn("rule", listed_rule(listed))
    verdict = F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")
    for host, path, said in listed:
        verdict = F.when(F.col("rule") == f"{host}{path}", said).otherwise(verdict)
    return d.withColumn("verdict", verdict).drop("_url", "_hit")
