"""Quality rules, line runs, URL rules and personal data."""



import brute
import pytest
from pyspark.sql import functions as F

from millrace.llm import line_runs, pii_bootstrap, quality_rules, url_rules


def test_quality_equals_brute_force(spark, edge, edge_rows):
    got = quality_rules.judge(edge).collect()
    want = sorted((i, *brute.quality(t or "")) for i, t in edge_rows if i is not None)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"], *(r[c] for c in names)) for r in got if r["doc_id"] is not None) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert got[0]["score"] == "x"


def test_quality_of_nothing(empty):
    assert quality_rules.judge(empty).count() == 0


def test_rules_compile_into_one_projection(spark, edge):
    rules = (quality_rules.Rule("short", "n_words", 1, 2),)
    got = {r["doc_id"]: r["ok"] for r in quality_rules.measures(edge.filter("doc_id IN (1, 9, 3)")).select("doc_id", quality_rules.compile_rules(rules).alias("ok")).collect()}
    assert got == {1: False, 9: True, 3: False}


def test_lines_equal_brute_force(spark, texts):
    rows = [*texts.items(), (900, "A line that is long enough\nother"), (901, "a LINE that is long enough  "), (902, None), (902, "\ta line that is long enough\n\n"), (903, ""), (904, "two documents hold this line"), (905, "two documents hold this line"), (905, "two documents hold this line\nx"), (None, "two documents hold this line"), (None, "a line that is long enough")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: (x[0] is None, str(x))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_runs.drop_repeated(d).collect()), key=order)
    assert list(map(str, got)) == list(map(str, sorted(brute.dropped_lines(rows), key=order)))
    assert sum(x[2] for x in got) > 0


def test_lines_of_edge_rows(edge, empty):
    got = line_runs.drop_repeated(edge)
    assert got.count() == edge.count() and "score" in got.columns
    assert line_runs.drop_repeated(empty).count() == 0


def test_repeated_rows_keep_their_lines_together(spark):
    line = "a line of more than twenty characters"
    d = spark.createDataFrame([(1, line), (2, line), (3, line), (3, line)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_runs.drop_repeated(d).collect()) == [(1, 1), (2, 1), (3, 0), (3, 0)]


def test_runs_compact_by_level(spark):
    runs = line_runs.LineRuns(spark, fan_in=2)
    for k in (4, 3, 2, 1, 0):
        d = spark.createDataFrame([(k, f"a line that comes back each time\nand one of its own, number {k}")], "doc_id long, text string")
        runs.add(line_runs.long_lines(d))
    assert [len(level) for level in runs.paths] == [1, 0, 1]
    counts = sorted((r["n_docs"], r["top_doc"]) for r in runs.merged().collect())
    assert counts == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (5, 4)]


def test_batches_lose_what_earlier_ones_had(spark):
    runs = line_runs.LineRuns(spark)
    one = spark.createDataFrame([(1, "this line is seen in both batches\nfirst batch only, this one")], "doc_id long, text string")
    two = spark.createDataFrame([(2, "second batch only, this line\nThis line is seen in both batches")], "doc_id long, text string")
    assert line_runs.drop_batch(runs, one).first()["n_dropped"] == 0
    assert line_runs.drop_batch(runs, two).first()["text"] == "second batch only, this line"


URLS = [
    (1, "https://A.Example.net/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "http://example.net/fr/1#y", "example.net", "/fr/1", "net/", "block"),
    (3, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    (4, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    (5, "x://w.org/fr/a://b", "w.org", "/fr/a://b", "org/fr/", "allow"),
    (6, None, "", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, "http://host?q", "host", "", None, "allow"),
    (8, "http://net", "net", "", None, "allow"),
]


def test_urls_are_parsed_and_judged(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_rules.judge(pages, labels).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(str((i, *x)) for i, _, *x in URLS)
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block_by_index(spark):
    bad = [(i, f"http://m.casino-win.example.com/en/{i}") for i in range(30)]
    good = [(100 + i, f"http://m.garden.example.com/en/{i}") for i in range(30)]
    pages = spark.createDataFrame([*bad, *good, (900, "http://www.casino-win.org/x"), (901, "http://www.garden.org/x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i, _ in bad] + [(i, False) for i, _ in good], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert got[900] == "block" and got[901] == "allow"
    assert all((v == "block") == (i < 100 or i == 900) for i, v in got.items())


def test_mined_rules_see_query_fragment_and_ending(spark):
    for bad, good in (("page?ad=win&n=3", "page?ad=tea&n=3"), ("page#win", "page#tea"), ("page.EXE", "page.html")):
        rows = [(i, f"http://a.example.com/en/{i}/{bad if i < 30 else good}") for i in range(60)]
        labels = spark.createDataFrame([(i, i < 30) for i in range(60)], "page_id long, bad boolean")
        got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
        assert all((r["verdict"] == "block") == (r["page_id"] < 30) for r in got) and len(got) == 60


def test_labels_that_say_nothing_of_urls_give_no_rule(spark):
    import random

    r = random.Random(8)
    rows = [(i, f"http://www.{r.choice('abcdefgh')}.example.com/{r.choice('xyz')}/{r.choice('klmn')}?q={r.choice('uvw')}", r.random() < 0.3) for i in range(3000)]
    d = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    assert url_rules.mine(url_rules.parse(d)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    import itertools
    import math
    import random

    def sure(bad, n, z=url_rules.SIGMAS):
        p = bad / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) >= url_rules.MIN_CONFIDENCE

    r = random.Random(5)
    rows = []
    for i in range(600):
        words = r.sample(["win", "bet", "tea", "cup", "sun", "sea"], 3)
        bad = {"win", "bet"} <= set(words) or ("sun" in words and r.random() < 0.1)
        rows.append((i, "http://h.example.com/" + "/".join(words) + f"/n{chr(97 + i % 26)}{chr(97 + i // 26)}", bad))
    # one long URL, and copies of it that differ in one word: 2 to the power 40 sets
    long = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows += [(1000 + i, "http://long.example.org/" + "/".join(w for k, w in enumerate(long) if k != i), True) for i in range(40)]
    parsed = url_rules.parse(spark.createDataFrame(rows, "page_id long, url string, bad boolean"))
    got = {tuple(x["antecedent"]) for x in url_rules.mine(parsed).collect()}
    baskets = [({"p:" + w for w in u.split("/")[3:]} | {"h:" + w for w in u.split("/")[2].split(".")}, b) for _, u, b in rows]
    want, names = set(), sorted({t for x, _ in baskets for t in x})
    for size in (1, 2, 3):
        for items in itertools.combinations(names if size == 1 else [t for t in names if t in ("p:win", "p:bet", "p:tea", "p:cup", "p:sun", "p:sea", "p:waa", "p:wab", "h:h", "h:com")], size):
            hits = [b for x, b in baskets if set(items) <= x]
            if len(hits) >= url_rules.MIN_COUNT and sure(sum(hits), len(hits)) and not any(set(w) <= set(items) for w in want):
                want.add(items)
    said = lambda rules, x: any(set(w) <= x for w in rules)
    assert ("p:bet", "p:win") in got and all(said(got, x) == said(want, x) for x, _ in baskets)
    assert {g for g in got if len(g) == 1} <= want


def test_rules_of_long_baskets_are_whole(spark):
    import random

    r = random.Random(7)
    names = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxy"]
    rows = []
    for i in range(400):
        words = set(r.sample(names, 16))
        rows.append((i, "http://h.example.com/" + "/".join(sorted(words)) + "/1", {"wa", "wb", "wc"} <= words or r.random() < 0.02))
    parsed = url_rules.parse(spark.createDataFrame(rows, "page_id long, url string, bad boolean"))
    rules = {tuple(x["antecedent"]): (x["n"], x["bad"]) for x in url_rules.mine(parsed).collect()}
    assert ("p:wa", "p:wb", "p:wc") in rules
    # the bound on FP-growth's baskets changes no verdict
    for largest in (1, 3):
        few = {tuple(x["antecedent"]): (x["n"], x["bad"]) for x in url_rules.mine(parsed, largest=largest).collect()}
        said = lambda found, u: any({t[2:] for t in a} <= set(u.split("/")[3:]) for a in found)
        assert all(said(few, u) == said(rules, u) == ({"wa", "wb", "wc"} <= set(u.split("/")[3:])) for _, u, _ in rows)
        assert all(rules.get(a, v) == v for a, v in few.items())


def test_pii_base_equals_brute_force(spark, texts, edge, edge_rows):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1", "1" * 20_000, "a.a." * 4000 + "@b" + ".c" * 4000, "4111 1111 1111 1111", "+1 (042) 555-7845 +12"]
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(odd))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii_bootstrap.find(d).select("doc_id", pii_bootstrap.spans_text(F.col("base")).alias("s")).collect()}
    assert got == {i: brute.pii_spans(t) for i, t in rows}
    found = pii_bootstrap.find(edge).collect()
    assert len(found) == len(edge_rows) and not any(r["base"] or r["added"] for r in found)


def test_pii_of_nothing(empty):
    assert pii_bootstrap.find(empty).count() == 0 and pii_bootstrap.redact(empty).count() == 0


def test_context_finds_unseen_identifiers(spark):
    seeds = [(i, f"please call the office number +1 ({200 + i}) 555-{1000 + i} before noon") for i in range(12)]
    more = [
        (50, "please call the office number (212) 555-9876 before noon"),
        (51, "a measured height of (212) 555-9876 millimetres"),
        (52, "please call the office number ring-0042-ext before noon"),  # found by its place, whatever its looks
        (53, "please call the office number 12 before noon"),
    ]
    d = spark.createDataFrame(seeds + more, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in pii_bootstrap.find(d).collect()}
    text = more[0][1]
    assert [text[a:b] for a, b in got[50]] == ["(212) 555-9876"] and got[51] == [] == got[53]
    assert [more[2][1][a:b] for a, b in got[52]] == ["ring-0042-ext"]
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(d).collect()}
    assert clean[0] == "please call the office number [PHONE] before noon" == clean[50] and clean[51] == more[1][1]


def test_found_identifiers_bear_out_other_contexts(spark):
    """Strings found by one context make a second context's pattern, which holds no seed, and that finds others."""
    rows = [(i, f"reach me at phone {'+1 ' if i < 30 else ''}(200) 555-{1000 + i} please thanks") for i in range(40)]
    rows += [(100 + i, f"our desk switchboard: (200) 555-{1030 + i} is open") for i in range(10)]
    rows += [(200, "our desk switchboard: (200) 777-0000 is open")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in pii_bootstrap.find(d).collect()}
    assert len(got[35]) == 1 and len(got[200]) == 1 and got[200][0]["kind"] == 3


def test_added_spans_equal_brute_force(spark, texts):
    rows = list(texts.items())[:120]
    rows += [(10_000 + i, f"please call the office number {'+1 ' if i % 4 else ''}(200) 555-{1000 + i} before noon") for i in range(24)]
    rows += [(10_100 + i, f"ping host 10.0.{i}.{255 if i % 5 else 999} now\nkey=AKIA{i:016d} or pass: deadbeef{i:08d}") for i in range(30)]
    rows += [(10_200, "key=zzzz-9999-yyyy or key=12345 and mail a.b@c.de, mail x_9@y"), (10_201, "1 2 3 " * 40), (10_202, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii_bootstrap.find(d).collect()}
    want = brute.pii_added(rows)
    assert got == want and any(k < 4 for x in want.values() for k, _, _ in x)


def test_pii_of_long_texts(spark):
    import time

    numbers = " ".join(str(10_000 + i % 90_000) for i in range(160_000))
    mails = "é " + " ".join(f"u{i}@m.example.com" for i in range(8000))
    d = spark.createDataFrame([(1, numbers), (2, mails), (3, "a" * 500_000), (4, "a@b" + ".c" * 200_000), (5, "deadbeef1" * 60_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (len(r["base"]), len(r["added"])) for r in pii_bootstrap.find(d).collect()}
    assert got == {1: (0, 0), 2: (8000, 0), 3: (0, 0), 4: (1, 0), 5: (0, 1)} and time.time() - began < 120
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(d).collect()}
    assert clean[1] == numbers and clean[2] == "é " + " ".join(["[EMAIL]"] * 8000) and clean[5] == "[SECRET]"


@pytest.mark.parametrize("text,want", [("a x@y.zz b", "a [EMAIL] b"), (None, None), ("", ""), ("call +1 222 333 4444 x@y.zz", "call [PHONE] [EMAIL]")])
def test_redaction(spark, text, want):
    d = spark.createDataFrame([(1, text, "k")], "doc_id long, text string, _s string")
    assert pii_bootstrap.redact(d).first()["text"] == want


