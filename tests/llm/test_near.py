"""Near-duplicate documents and repeated passages."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import compact_windows as cw
from millrace.llm import dart_minhash as dm
from millrace.llm.components import components


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    off = []
    for _ in range(60):
        x = np.unique(rng.integers(1, 2**63, 300).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[:240], rng.integers(1, 2**63, 60).astype(np.uint64)]))
        wx = rng.integers(1, 4, len(x)) / 2
        known = dict(zip(x.tolist(), wx.tolist(), strict=True))
        wy = np.array([known.get(v, 1.0) for v in y.tolist()])
        off.append((dm.dart_signature(x, wx, 160) == dm.dart_signature(y, wy, 160)).mean() - dm.weighted_jaccard(x, wx, y, wy))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def near_classes(rows):
    sets = {i: dm.shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a][0]) and len(sets[b][0]) and dm.weighted_jaccard(*sets[a], *sets[b]) >= 0.8]
    blank = {}
    for i, t in sorted(rows):
        if not len(sets[i][0]):
            links.append((blank.setdefault(t, i), i))
    return brute.components(ids, links)


def test_classes_equal_brute_force(spark, texts):
    rng = np.random.default_rng(5)
    base = " ".join(f"word{i}" for i in range(120))
    crowd = []
    for i in range(150):  # near copies of one text, most of them further than 0.8 from each other
        words = base.split()
        words[int(rng.integers(120))] = f"other{i}"
        crowd.append((10_000 + i, " ".join(words)))
    shared = " ".join(f"common{i}" for i in range(60))
    apart = [(20_000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(80)]
    rows = [*texts.items(), *crowd, *apart, (30_000, base), (30_001, base), (30_002, "!!!"), (30_003, "!!!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dm.classify(d).collect()}
    assert got == near_classes(rows)
    kept = {r["doc_id"] for r in dm.drop_near_duplicates(d).collect()}
    assert kept == set(got.values())


def test_a_bucket_of_many_components(spark):
    """Thousands of different texts that share every bucket of a formula: tasks stay bounded, and the few alike ones are found."""
    import unittest.mock as mock

    head = [f"common{i}" for i in range(90)]
    rows = [(i, " ".join(head + [f"own{i}x{k}" for k in range(40)])) for i in range(1200)]
    rows += [(5000 + i, " ".join(head + [f"own{i}x{k}" for k in range(36)] + ["new"] * 4)) for i in range(0, 1200, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    with mock.patch.object(dm, "BLOCK", 256):
        got = {r["doc_id"]: r["class_id"] for r in dm.classify(d).collect()}
    assert got == near_classes(rows) and sum(i != c for i, c in got.items()) == 30


def test_least_agreeing_is_the_binomial_tail():
    import math

    m = dm.least_agreeing()
    tail = lambda m: sum(math.comb(160, j) * 0.8**j * 0.2 ** (160 - j) for j in range(m))
    assert tail(m) <= 1e-9 < tail(m + 1)


def test_texts_of_one_doc_id_are_compared_each(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in dm.classify(d).collect()} == {1: 1, 2: 1, 3: 1}


def test_edge_rows(edge, edge_rows, empty):
    got = dm.classify(edge).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r["class_id"] for r in got}
    assert by_id[3] == by_id[4] == 3 and by_id[1] == by_id[2] == 1 and by_id[9] == 9 and by_id[None] is None
    assert dm.classify(empty).count() == 0
    kept = dm.drop_near_duplicates(edge)
    assert set(kept.columns) == set(edge.columns) and {r["doc_id"] for r in kept.collect()} >= {1, 3, 5, None}


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for x in links for n in x}
    assert got == brute.components(nodes, links)


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(7)
    for room in (5, 16, 46):
        h = rng.permutation(300)
        found = []

        def walk(left, right, room=room, h=h, found=found):
            if right - left + 1 >= room:
                c = left + int(np.argmin(h[left : right + 1]))
                found.append((max(left, c - room + 1), min(right, c + room - 1), int(h[c])))
                walk(left, c - 1)
                walk(c + 1, right)

        walk(0, len(h) - 1)
        assert sorted(cw.compact_windows(h, room)) == sorted(found)
    assert cw.compact_windows(rng.permutation(3), 5) == []


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{seed}x{i}" for i in rng.integers(0, 10_000, n)]


def test_shared_passages_are_found_where_they_are(spark):
    passage = words(1, 70)
    rows = [(i, " ".join(words(10 + i, 30 + 13 * i) + passage + words(50 + i, 90))) for i in range(6)]
    near = list(passage)
    near[30] = "changed"
    rows += [(20, " ".join(words(90, 40) + near)), (21, " ".join(words(91, 400))), (22, " ".join(words(92, 80) + passage[:30])), (23, None), (24, ""), (None, " ".join(passage))]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = cw.memberships(d).collect()
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in got}
    assert set(spans) == {0, 1, 2, 3, 4, 5, 20}
    for i in range(6):
        assert spans[i] == (30 + 13 * i, 100 + 13 * i)
    assert all(r["likeness"] >= 0.8 and r["representative"] <= r["doc_id"] for r in got)


def test_long_shared_runs_equal_brute_force(spark, texts):
    rows = list(texts.items())
    got = {r["doc_id"] for r in cw.memberships(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    room = cw.LEAST_WORDS - cw.WIDTH + 1
    holders = {}
    for i, t in rows:
        s = cw.sequence(t)
        if len(np.unique(s)) > 0.9 * len(s):  # texts that repeat themselves match in many ways
            for p in range(len(s) - room + 1):
                holders.setdefault(s[p : p + room].tobytes(), set()).add(i)
    want = {i for h in holders.values() if len(h) > 1 for i in h}
    assert want and want <= got


def test_passages_of_nothing(edge, empty):
    got = cw.memberships(edge).collect()
    assert {r["doc_id"] for r in got} <= {3, 4, 5, 11} and {3, 4} <= {r["doc_id"] for r in got}
    assert cw.memberships(empty).count() == 0


@pytest.mark.parametrize("a,b,want", [(range(60), range(60), [(0, 60, 0, 60, 1.0)]), (range(60), range(100, 160), []), ([], [], []), (range(45), range(45), [])])
def test_passages(a, b, want):
    assert cw.passages(np.array(a, np.uint32), np.array(b, np.uint32)) == want


def uncovered(a, b, room):
    """Windows of a that b holds word for word and no passage covers."""
    held = {b[j : j + room].tobytes() for j in range(len(b) - room + 1)}
    spans = [p[:2] for p in cw.passages(a, b)]
    return [i for i in range(len(a) - room + 1) if a[i : i + room].tobytes() in held and not any(x <= i and i + room <= y for x, y in spans)]


def test_passages_that_occur_again_equal_brute_force():
    rng = np.random.default_rng(11)
    room = cw.LEAST_WORDS - cw.WIDTH + 1

    def seq(text):
        return (cw.sequence(" ".join(text)) >> np.uint64(32)).astype(np.uint32)

    p = words(200, 54)
    titled, once = seq(p[:10] + words(201, 70) + p), seq(p)
    assert cw.passages(titled, once) == [(80, 130, 0, 50, 1.0)]
    twice = seq(p + words(202, 40) + p)
    assert {x[:2] for x in cw.passages(twice, once)} == {(0, 50), (94, 144)}
    parts = [words(300 + k, int(n)) for k, n in enumerate(rng.integers(8, 90, 8))]
    for _ in range(150):
        a, b = (seq([w for k in rng.integers(0, 8, 7) for w in parts[k]]) for _ in range(2))
        assert not uncovered(a, b, room) and not uncovered(b, a, room)
    page = seq(["word"] * 5000)
    assert cw.passages(page, page[:3000])


def test_formula_of_many_hides_no_passage_of_two(spark):
    formula = words(400, 40)
    rows = [(i, " ".join(words(500 + 2 * i, 30) + formula + words(501 + 2 * i, 40))) for i in range(120)]
    want = set()
    for k in range(15):
        tail = words(800 + k, 10)
        for i in (200 + 2 * k, 201 + 2 * k):
            rows.append((i, " ".join(words(900 + i, 30) + formula + tail + words(2000 + i, 40))))
            want.add(i)
    found = cw.memberships(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in found} == {(i, 30, 80) for i in want}


def test_families_with_a_common_head_are_found(spark):
    """Passages of 50 words that begin with the same 44 words: the rest tells the families apart."""
    head = words(600, 44)
    rows, want = [], set()
    for k in range(100):
        passage = head + words(700 + k, 6)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(words(3000 + i, 40) + passage + words(6000 + i, 40))))
        want.add((2 * k, 2 * k + 1))
    found = cw.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r["a"], r["b"]) for r in found if r["a_end"] - r["a_start"] >= 50}


def test_recall_of_near_passages(spark):
    """Links of passages at the threshold and above, of one window's length and more, against all pairs compared."""
    rng = np.random.default_rng(17)
    rows, want, room = [], set(), cw.LEAST_WORDS - cw.WIDTH + 1
    for k in range(260):
        passage = words(10_000 + k, int(rng.integers(50, 90)))
        near = list(passage)
        for p in rng.integers(2, len(near) - 2, int(rng.integers(1, 3))):
            near[p] = f"changed{k}"
        texts = [words(20_000 + 2 * k + j, 30) + x + words(40_000 + 2 * k + j, 30) for j, x in enumerate((passage, near))]
        rows += [(2 * k + j, " ".join(t)) for j, t in enumerate(texts)]
        a, b = ((cw.sequence(" ".join(t)) >> np.uint64(32)).astype(np.uint32) for t in texts)
        if cw.passages(a, b, room):
            want.add((2 * k, 2 * k + 1))
    got = {(r["a"], r["b"]) for r in cw.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("links", len(want), "found", len(got & want))
    assert got <= want and len(want) >= 150 and len(got & want) >= 0.9 * len(want)


def test_rarest_shingles_meet():
    """Two sets with THRESHOLD * least or more in common share one of either's rarest."""
    rng = np.random.default_rng(19)
    for _ in range(300):
        x = np.unique(rng.integers(0, 90, 60)).astype(np.int32)
        y = np.unique(np.append(rng.permutation(x)[: int(rng.integers(20, len(x)))], rng.integers(0, 200, 15))).astype(np.int32)
        counts = dict(zip(range(200), rng.integers(2, 50, 200).tolist(), strict=True))
        both = np.intersect1d(x, y)
        least = int(rng.integers(10, 46))
        if len(both) >= cw.THRESHOLD * least:
            only = lambda s: np.array([v for v in s if v in both or counts[v] > 10], np.int32)
            p, q = (cw.rarest(s, only(s), np.array([counts[v] for v in only(s)]), least) for s in (x, y))
            assert len(np.intersect1d(p, q))


def test_blocks_of_a_signature_meet():
    rng = np.random.default_rng(13)
    parts = [rng.integers(0, 2**32, 60).astype(np.uint32) for _ in range(12)]
    parts[7] = parts[2].copy()
    parts[9] = parts[4].copy()
    parts[9][30] = 5  # alike, but no 46 shingles in a row are equal
    doc, open_ = np.arange(12) * 10, np.ones(12, bool)
    assert cw.across(doc, open_, np.zeros(12, int), parts) == [(20, 70), (40, 90)]
    own = np.array([0, 1] * 6)
    assert cw.across(doc, open_, own, parts) == [(20, 70), (40, 90)]
    own[7] = own[2]
    assert cw.across(doc, open_, own, parts) == [(40, 90)]
    open_[[2, 4]] = False
    assert cw.across(doc, open_, np.zeros(12, int), parts) == [(20, 70), (40, 90)]


def test_classes_of_a_signature_equal_brute_force():
    """Rows that are tied to others already meet the rest: the links make the classes that all pairs give."""
    rng = np.random.default_rng(23)
    chains = 0
    for trial in range(60):
        parts = []
        for _ in range(6):
            base = rng.integers(0, 2**32, 64).astype(np.uint32)
            if trial % 4 == 3:
                base[20:40] = base[:20]
            for _ in range(2):
                near = base.copy()
                near[rng.integers(0, 64, int(rng.integers(0, 7)))] = rng.integers(0, 2**32)
                parts += [near, np.append(near[int(rng.integers(0, 20)) :], rng.integers(0, 2**32, 9).astype(np.uint32))]
        parts += [np.append(parts[0][:41], rng.integers(0, 2**32, 20).astype(np.uint32)) for _ in range(3)]
        n = len(parts)
        open_ = np.append(False, np.ones(n - 1, bool))
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if cw.passages(parts[i], parts[j])]
        want = brute.components(range(n), pairs)
        doc = np.arange(n)
        one = cw.across(doc, open_, np.zeros(n, int), parts)
        blocks = [x for lo, hi in ((0, 1), (0, 0), (1, 1)) if (k := np.flatnonzero((doc % 2 == lo) | (doc % 2 == hi))).size for x in cw.across(doc[k], open_[k], doc[k] % 2, [parts[i] for i in k])]
        for found in (one, blocks):
            assert set(found) <= set(pairs) and brute.components(range(n), found) == want
        chains += len(set(pairs)) > len(one)
    assert chains > 30


def test_every_document_has_its_class(spark):
    p = words(5000, 80)
    near = lambda places: [f"c{k}" if k in places else w for k, w in enumerate(p)]
    texts = [p, near([39]), words(5001, 60) + p[:60], words(5002, 90), words(5003, 70), words(5003, 70)]
    got = cw.memberships(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(0, 0), (1, 0), (2, 0), (4, 4), (5, 4)}


def test_too_little_in_common_is_told_before_places(monkeypatch):
    """Two texts that repeat a formula, but have too few shingles in common for a passage, aren't compared place by place."""
    rng = np.random.default_rng(29)
    formula = rng.integers(0, 2**32, 20).astype(np.uint32)
    a, b = (np.concatenate([x for _ in range(2) for x in (rng.integers(0, 2**32, 50).astype(np.uint32), formula[:12])]) for _ in range(2))
    monkeypatch.setattr(cw, "_seeded", lambda *x: pytest.fail("compared"))
    assert cw.passages(a, b) == []


def test_links_hold_in_the_order_in_which_they_are_verified():
    """Cuts may fall elsewhere the other way round, so a link is tried from the lesser doc, whichever row is open."""
    rng = np.random.default_rng(31)
    uneven = 0
    for _ in range(1500):
        a = rng.integers(0, 2**32, 66).astype(np.uint32)
        b = a
        for p in np.sort(rng.integers(0, 62, int(rng.integers(2, 5))))[::-1]:
            b = np.concatenate([b[:p], rng.integers(0, 2**32, int(rng.integers(2, 7))).astype(np.uint32), b[p + int(rng.integers(2, 7)) :]])
        one, two = (bool(cw.passages(*x)) for x in ((a, b), (b, a)))
        if one != two:
            uneven += 1
            for first in (True, False):
                assert bool(cw.across(np.array([3, 8]), np.array([first, not first]), np.zeros(2, int), [a, b])) == one
    assert uneven >= 3


def test_codes_of_arrow_texts_look_at_different_chunks_once():
    """WordCodes.of gives the words' codes that codes() gives, and the cache meets each different chunk of a run of texts once."""
    from millrace.llm import _common

    texts = ["A b,\x1cc\x85d  É　e", "", "  ", "x" * 100 + " ¿qué? …"] + ["one two, One"] * 900
    words, seen = _common.WordCodes(), []

    class Seen(_common.WordCodes):
        def __getitem__(self, c):
            seen.append(c)
            return super().__getitem__(c)

    given = pa.array(["-", *texts]).slice(1)
    assert [x[x != 0].tolist() for x in Seen().of(given)] == [x[x != 0].tolist() for x in map(words.codes, texts)]
    assert sorted(seen) == sorted({c for t in texts for c in t.split()} | {""})
    assert [x.tolist() for x in cw._words().of(given.slice(0, 0))] == []
