"""Personal data: four kinds by fixed patterns, and more by bootstrapped contextual extraction.

Built-in functions only. Seeds are what the fixed patterns find, and credentials of known make (kind `secret`). What stands
around a seed induces lexical patterns: the words and the separators before it, the word behind it, its shape. The patterns
are then applied to the whole corpus: every string with a digit or an @ that stands in such a place is an instance, whatever
its looks. Instances and patterns form a graph on which scores go to and fro until they settle: a pattern is as good as the
instances it extracts, an instance as good as the patterns of other contexts that extract it; seeds are certain. Only words
that stand before identifiers more often than elsewhere around them head a pattern, so ordinary prose extracts nothing.
What a pattern of high score and wide support extracts is personal data too, and supports other patterns in its turn.

Expressions are possessive or lazy where that changes nothing, begin only where a run of their characters begins (or the
last match ended) and don't nest repetitions, so a text takes time in proportion to its length, and a text with m finds
takes another m to the power 1.5.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialise, text_or_empty

#: The fixed patterns' kinds, and that of the credentials, whose spans are additions.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Cards are runs of digits with single separators: only whole runs of 16 to 19 digits can pass their check.
SEEDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+)(?![0-9A-Za-z])",
}

#: What separates strings, the mark that covers seeds among them, as the inside of a character class.
_APART = r"\s=\"'<>|;,"
_MASK = ""
#: Any string with a digit or an @, from the first of these on, and up to seven groups of digits behind it.
INSTANCE = rf"[0-9@][^{_APART}]*+(?:\x20[().+-]{{0,3}}+[0-9][().+0-9-]{{0,24}}+(?![^{_APART}])){{0,7}}+"
#: Letters and digits of the shortest and the longest instance.
LEAST, MOST = 6, 64

#: A pattern is trusted from this score on, if instances of so much score in sum bear it out.
MIN_SCORE, MIN_SUPPORT = 0.75, 5.0
#: The share of a word's places around instances that are right before one, from which on it heads patterns. Ordinary words
#: have about one in fourteen; where identifiers stand close together, a place counts for each of them.
TELLING = 0.25
#: Scores have settled when none changes by more; the rounds end there, or here.
SETTLED, ROUNDS = 1e-3, 12
#: Code points on either side of an instance that its patterns look at.
REACH = 48


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, 0 and all earlier ones put together by op, in parts of about the square root of their number."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / size).cast("int"), F.lit(0))), lambda c: F.slice(values, c * size + 1, size))
    run = lambda items, first: F.aggregate(items, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
    heads = run(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op)), F.lit(0))
    return F.flatten(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), lambda p, h: F.slice(run(p, h), 1, F.size(p))))


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _with_finds(d: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """d with `out`, the leftmost non-overlapping matches as (start, end, found, before, after); code points from 0, end exclusive."""
    t = F.col(text)
    d = d.withColumn("_has", t.rlike(pattern))
    d = d.withColumn("_found", F.when(F.col("_has"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    d = d.withColumn("_gaps", F.when(F.col("_has"), F.split(t, pattern, -1)))
    d = d.withColumn("_steps", F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, f: F.length(g) + F.length(f)))
    d = d.withColumn("_at", F.when(F.col("_has"), _before(F.col("_steps"), _add)))
    placed = F.zip_with(
        F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, f: F.struct(g.alias("gap"), f.alias("found"))),
        F.zip_with("_at", F.slice("_gaps", 2, F.size("_found")), lambda at, gap: F.struct(at.alias("at"), F.left(gap, F.lit(REACH)).alias("after"))),
        lambda p, n: F.struct(
            (n["at"] + F.length(p["gap"])).alias("start"),
            (n["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("end"),
            p["found"].alias("found"),
            F.right(p["gap"], F.lit(REACH)).alias("before"),
            n["after"].alias("after"),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
    return d.withColumn(out, F.coalesce(placed, none)).drop("_has", "_found", "_gaps", "_steps", "_at")


#: Code points of the blocks that a text is cut into before parts of it are taken out.
_BLOCK = 4096


def _part(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text in blocks, in time in proportion to their number and a block's."""
    i, j = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    across = F.concat(F.substring(block(i), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(block(j), F.lit(1), b % _BLOCK))
    return F.when(i == j, F.substring(block(i), a % _BLOCK + 1, b - a)).otherwise(across)


def _with_replaced(d: DataFrame, text: Column, spans: str, out: str, put: Callable[[Column, Column], Column]) -> DataFrame:
    """d with `out`, the text with put(span, end of the spans before) in each span's place; spans are in order of start.

    Where `spans` is null or empty, so is `out` null.
    """
    d = d.withColumn("_blocks", F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))
    d = d.withColumn("_ends", F.when(F.size(spans) > 0, _before(F.transform(spans, lambda s: s["end"]), _greater)))
    told = F.zip_with(spans, "_ends", lambda s, end: F.concat(F.when(s["start"] > end, _part(F.col("_blocks"), end, s["start"])).otherwise(F.lit("")), put(s, end)))
    rest = _part(F.col("_blocks"), F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
    return d.withColumn(out, F.when(F.size(spans) > 0, F.concat(F.array_join(told, ""), rest))).drop("_blocks", "_ends")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return _luhn(_digits(found))
    n = F.length(_digits(found))
    return (n >= 8) & (n <= 15)


def _found_holds(kind: str, x: Column) -> Column:
    return _holds(kind, x["found"])


def _context(x: Column) -> Column:
    """(start, end, what, word, head, patterns, words): the find without punctuation at its ends, its lexical patterns as 64-bit
    codes, that of the word before it, that of this word with the separators, those of all words around it."""
    lead = F.regexp_extract(x["found"], r"^[^0-9A-Za-z(+]*", 0)
    tail = F.regexp_extract(x["found"], r"[^0-9A-Za-z)]*$", 0)
    core = F.substring(x["found"], F.length(lead) + 1, F.length(x["found"]) - F.length(lead) - F.length(tail))
    before, after = F.lower(F.concat(x["before"], lead)), F.lower(F.concat(tail, x["after"]))
    word = F.regexp_extract(before, r"(\p{L}++)[^\p{L}]{0,12}$", 1)
    gap = F.regexp_replace(F.regexp_extract(before, r"\p{L}([^\p{L}]{0,12})$", 1), r"\s+", " ")
    further = F.regexp_extract(before, r"(\p{L}++)[^\p{L}]++\p{L}++[^\p{L}]{0,12}$", 1)
    then = F.regexp_extract(after, r"^[^\p{L}]{0,12}(\p{L}++)", 1)
    mixed = r"(?<![0-9A-Za-z])(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z]{8,}"
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, mixed, "*"), "[0-9]", "0"), "[A-Za-z]+", "a")
    head = F.xxhash64(word, gap)
    patterns = F.array(
        F.xxhash64(F.lit(1), head, shape),
        F.when(then != "", F.xxhash64(F.lit(2), head, then)),
        F.when(further != "", F.xxhash64(F.lit(3), head, further)),
    )
    # a word cut by the edge of the reach counts as another word, which does no harm
    words = F.regexp_extract_all(F.concat(before, F.lit(" "), after), F.lit(r"\p{L}++"), F.lit(0))
    start = x["start"] + F.length(lead)
    return F.struct(
        start.alias("start"),
        (start + F.length(core)).alias("end"),
        F.xxhash64(F.lower(core)).alias("what"),
        F.xxhash64(word).alias("word"),
        F.when(word != "", head).alias("head"),
        F.when(word != "", F.filter(patterns, lambda p: p.isNotNull())).otherwise(F.array().cast("array<bigint>")).alias("patterns"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.regexp_replace(core, "[^0-9A-Za-z]", "")).alias("n"),
    )


def _whole(x: Column) -> Column:
    """An instance with what stands before its first digit or @ in the same string."""
    begin = F.regexp_extract(x["before"], rf"[^{_APART}]*$", 0)
    return F.struct(
        (x["start"] - F.length(begin)).alias("start"), x["end"].alias("end"), F.concat(begin, x["found"]).alias("found"),
        F.left(x["before"], F.length(x["before"]) - F.length(begin)).alias("before"), x["after"].alias("after"),
    )


def _told(kind: int | None, x: Column) -> Column:
    return F.struct(F.lit(kind).cast("int").alias("kind"), _context(x).alias("x"))


def _covering(s: Column, end: Column) -> Column:
    return F.repeat(F.lit(_MASK), F.greatest(s["end"] - F.greatest(s["start"], end), F.lit(0)))


def seeds(d: DataFrame, text: str = "_t") -> DataFrame:
    """d with _e0, _e1, ... by kind: the finds that their kinds' checks let stand; and _rest, the text with them covered."""
    for i, kind in enumerate(KINDS):
        d = _with_finds(d, text, SEEDS[kind], f"_e{i}")
        d = d.withColumn(f"_e{i}", F.filter(f"_e{i}", partial(_found_holds, kind)))
    every = F.flatten(F.array(*[F.transform(f"_e{i}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for i in range(len(KINDS))]))
    d = _with_replaced(d.withColumn("_s", F.sort_array(every)), F.col(text), "_s", "_rest", _covering)
    return d.withColumn("_rest", F.coalesce("_rest", text)).drop("_s")


_FIND = "struct<kind:int,start:int,end:int>"


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, secrets, finds): a row's spans of the fixed patterns, those of credentials, and all its seeds
    (kind) and instances (kind null) with their contexts."""
    d = docs.select("doc_id", text_or_empty().alias("_t")).withColumn("row_key", F.xxhash64("_t"))
    d = _with_finds(seeds(d), "_rest", INSTANCE, "_c").withColumn("_c", F.transform("_c", _whole))
    plain = lambda i: F.transform(f"_e{i}", lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    told = [F.transform(f"_e{i}", partial(_told, i)) for i in range(len(KINDS))]
    loose = F.transform("_c", partial(_told, None))
    loose = F.filter(loose, lambda f: F.coalesce(f["x"]["n"].between(LEAST, MOST), F.lit(False)))
    base = F.concat(*map(plain, range(len(BASE_KINDS)))).cast(f"array<{_FIND}>")
    return d.select("doc_id", "row_key", base.alias("base"), plain(len(KINDS) - 1).cast(f"array<{_FIND}>").alias("secrets"), F.concat(*told, loose).alias("finds"))


def trusted_patterns(finds: DataFrame, min_score: float = MIN_SCORE, min_support: float = MIN_SUPPORT, telling: float = TELLING, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, p) of high score and support, from finds (kind, x).

    A string counts once for each pattern, however many rows have it. A pattern's score for a kind is the mean of its
    instances' scores; an instance that is no seed scores for a pattern the chance that one of the other contexts' best
    patterns is right. So two patterns of one place don't bear each other out.
    """
    heads = finds.groupBy(F.col("x.word").alias("word")).agg(F.count("*").alias("right"))
    around = finds.select(F.explode("x.words").alias("word")).groupBy("word").agg(F.count("*").alias("all"))
    heads = heads.join(around, "word").filter(F.col("right") >= telling * F.col("all")).select("word")
    told = finds.select("kind", "x.what", "x.head", "x.patterns", F.col("x.word").alias("word")).filter("head IS NOT NULL").join(heads, "word")
    edges = told.select("what", "head", "kind", F.explode("patterns").alias("pattern")).groupBy("what", "head", "pattern").agg(F.max("kind").alias("seed"))
    edges = materialise(edges, "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    sure = edges.filter("seed IS NOT NULL").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("f"))
    open_ = edges.filter("seed IS NULL").select("what", "head", "pattern")
    extra, last = None, None
    for _ in range(rounds):
        held = sure if extra is None else sure.unionByName(extra)
        p = held.groupBy("pattern", "kind").agg(F.sum("f").alias("support")).join(sizes, "pattern")
        p = materialise(p.select("pattern", "kind", "support", (F.col("support") / F.col("n")).alias("p")), "pii-patterns")
        if last is not None:
            moved = p.join(last.select("pattern", "kind", F.col("p").alias("q")), ["pattern", "kind"], "left").agg(F.max(F.col("p") - F.coalesce("q", F.lit(0.0)))).first()[0]
            if (moved or 0.0) <= SETTLED:
                break
        last = p
        good = p.filter(F.col("support") >= min_support)
        best = open_.join(good, "pattern").groupBy("what", "kind", "head").agg(F.max("p").alias("p"))
        best = best.withColumn("miss", F.log(F.greatest(1 - 0.9 * F.col("p"), F.lit(1e-9))))
        known = materialise(best, "pii-known")
        whole = known.groupBy("what", "kind").agg(F.sum("miss").alias("every"))
        seen = open_.join(whole, "what").join(known.select("what", "kind", "head", "miss"), ["what", "kind", "head"], "left")
        extra = materialise(seen.select("pattern", "kind", (1 - F.exp(F.col("every") - F.coalesce("miss", F.lit(0.0)))).alias("f")).filter("f > 1e-6"), "pii-extra")
    return p.filter((F.col("p") >= min_score) & (F.col("support") >= min_support)).select("pattern", "kind", "p")


def find(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, row_key, base, added): a row's spans (kind, start, end) of the fixed patterns; credentials and what contexts add.

    row_key tells rows that share a doc_id apart, unless their texts are equal too; equal rows give equal spans, each.
    Null texts are empty and have no span; a null doc_id is kept; an empty table gives an empty one; other columns are left out.
    Very long texts are read whole, in time about in proportion to their length.
    """
    scan = materialise(_scan(docs), "pii-scan")
    finds = scan.select("doc_id", "row_key", F.explode("finds").alias("f")).select("doc_id", "row_key", "f.*")
    trusted = trusted_patterns(finds, **bounds).withColumnRenamed("kind", "said")
    loose = finds.filter("kind IS NULL").select("doc_id", "row_key", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    hits = loose.join(trusted, "pattern").groupBy("doc_id", "row_key", "start", "end").agg(F.max_by("said", F.struct("p", -F.col("said"))).alias("kind"))
    added = hits.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
    added = added.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    d = scan.select("doc_id", "row_key", "base", "secrets")
    d = d.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    none = F.array().cast(f"array<{_FIND}>")
    return d.select("doc_id", "row_key", "base", F.sort_array(F.concat("secrets", F.coalesce("more", none))).alias("added"))


def is_kind(kind: int):
    return lambda s: s["kind"] == kind


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, **bounds) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; spans that overlap become one, of the first's kind.

    A null text stays null, rows with a null doc_id and repeated rows are redacted like others, an empty table stays empty;
    other columns pass through, but for _k, _id, _key, _s, _told, _blocks and _ends.
    """
    spans = find(docs, **bounds).select(
        F.col("doc_id").alias("_id"),
        F.col("row_key").alias("_key"),
        F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("_s"),
    )
    spans = spans.filter(F.size("_s") > 0).dropDuplicates(["_id", "_key"])
    text = text_or_empty()
    docs = docs.drop("_k", "_id", "_key", "_s", "_told", "_blocks", "_ends")
    d = docs.withColumn("_k", F.xxhash64(text))
    d = d.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    named = lambda s, end: F.when(s["start"] >= end, names[s["kind"]]).otherwise(F.lit(""))
    d = _with_replaced(d, text, "_s", "_told", named)
    return d.select(*[F.coalesce("_told", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
