"""Fingerprints, packing, tokenization, toxicity."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe_automaton, hilbert_packing, spotsigs, toxicity_kn


def library_ids(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], tokenizer


def test_automaton_equals_library(spark, edge, edge_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe_automaton.encode_documents(edge, path).collect()
    texts = [t or "" for _, t in edge_rows]
    want, tokenizer = library_ids("byte_bpe_50k.json", texts)
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(want)
    assert sorted(r["decoded"] for r in got) == sorted(tokenizer.decode(x, skip_special_tokens=False) for x in want)
    assert bpe_automaton.encode_documents(empty, path).count() == 0


def test_automaton_on_random_strings():
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab \n'sé1日́!<|> \x1caaa===") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(400)]
    automaton = bpe_automaton.compile_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, _ = library_ids("byte_bpe_50k.json", texts)
    assert [np.frombuffer(automaton.encode(t), "<u4").tolist() for t in texts] == want
    assert all(automaton.decode(automaton.encode(t)) == t for t in texts)


def test_automaton_accepts_one_token_string_a_word():
    alphabet = {c: i for i, c in enumerate(bpe_automaton.byte_alphabet())}
    merges = [["a", "a"], ["a", "b"], ["aa", "b"], ["b", "c"]]
    vocab = alphabet | {"".join(m): 256 + k for k, m in enumerate(merges)}
    spec = {"model": {"vocab": vocab, "merges": merges}, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    automaton = bpe_automaton.TokenAutomaton(spec)

    def merged(word):
        parts = list(word)
        for left, right in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == left and parts[i + 1] == right:
                    parts[i : i + 2] = [left + right]
                i += 1
        return [vocab[p] for p in parts]

    import itertools

    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert automaton.encode_word(word.encode()) == merged(word), word


def pieces_hold(rows, docs, length):
    """docs: doc_id -> list of id lists (rows that share a doc_id)."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, mine in by_doc.items():
        if len(docs[doc_id]) == 1:
            ids, at = docs[doc_id][0], 0
            for r in sorted(mine, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        assert sum(r["length"] for r in mine) == sum(map(len, docs[doc_id]))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at == length or at & (at - 1) == 0


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, edge, edge_rows, empty, length):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = hilbert_packing.pack(edge, path, length).collect()
    want, _ = library_ids("word_bpe_49k.json", [t or "" for _, t in edge_rows])
    docs = {}
    for (doc_id, _), ids in zip(edge_rows, want, strict=True):
        docs.setdefault(doc_id, []).append([*ids, 1])
    pieces_hold(rows, docs, length)
    assert hilbert_packing.pack(empty, path).count() == 0


def test_ids_equal_library():
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab \n'sS1日É́!<|> \x1cſİ,.") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["a,b", "Word. word, WORD!", "<|endoftext|>x", "L'été d'İstanbul ẞ ſ"]
    want, _ = library_ids("word_bpe_49k.json", texts)
    got = hilbert_packing.Ids(public_tokenizers.path("word_bpe_49k.json")).of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(hilbert_packing.hilbert_index(cells, bits))
        assert sorted(hilbert_packing.hilbert_index(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_near_texts_are_near_on_the_curve(texts):
    some = [t for t in texts.values() if len(t) > 500][:60]
    both = some + [t[:-40] for t in some]
    data = [t.encode() for t in both]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    spots = hilbert_packing.project(np.frombuffer(b"".join(data), np.uint8), starts)
    n = len(some)
    gaps = np.linalg.norm(spots[:n, None] - spots[None, n:], axis=2)
    assert (gaps.argmin(1) == np.arange(n)).mean() > 0.9


def test_edit_likeness(spark, edge, edge_rows, empty):
    got = spotsigs.edit_likeness(edge).collect()
    assert len(got) == len(edge_rows)
    ordered = sorted(edge_rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        a, b = a or "", b or ""
        changed = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y, z = map(spotsigs.signature, (a, changed, b))
        want.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), round(spotsigs.likeness(x, y), 9), round(spotsigs.likeness(x, z), 9)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (3, 4)]
    assert len(set(same)) == 1
    assert spotsigs.edit_likeness(empty).count() == 0
    one = spotsigs.edit_likeness(edge.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_spotsig_pairs_equal_brute_force(spark, texts):
    rows = list(texts.items()) + [(5000 + i, t + " and one more closing remark") for i, t in list(texts.items())[:40]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(spotsigs.fingerprints(d), 0.7)
    sigs, classes = {}, {}
    for i, t in sorted(rows):
        f = spotsigs.fingerprint(spotsigs.signature(t))
        classes.setdefault(f, i)
        if classes[f] == i and f:
            sigs[i] = set(spotsigs.read_fingerprint(f).tolist())
    ids = sorted(sigs)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.7}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) >= 30
    assert members.count() == len(rows)


def held_out_auc(got, labels):
    pos = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 1]
    neg = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_learns_from_other_folds_only(spark):
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], {}
    for i in range(1500):
        text = [r.choice(words) for _ in range(60)]
        labels[i] = int(r.random() < 0.2)
        if labels[i]:
            for _ in range(3):
                text[r.randrange(60)] = "zork" + r.choice(("", "ed", "ing"))
        rows.append((i, " ".join(text), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = toxicity_kn.judge(docs, marks).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert held_out_auc(got, labels) > 0.95
    changed = {i: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in labels.items()}
    again = toxicity_kn.judge(docs, spark.createDataFrame(list(changed.items()), "doc_id long, toxic int")).collect()
    assert {x["doc_id"]: x["score"] for x in got} == {x["doc_id"]: x["score"] for x in again}


def test_toxicity_without_labels_and_of_edge_rows(spark, edge, edge_rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_kn.judge(edge, none).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(3, 1), (5, 0), (4, 1), (8, 0), (11, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity_kn.judge(edge, some).count() == len(edge_rows)
    assert toxicity_kn.judge(empty, some).count() == 0


def test_toxicity_models_hold_every_string(spark):
    """Ratios of words against plain Kneser-Ney models of all counted words, whose strings are more than 150,000."""
    import random
    from collections import Counter, defaultdict

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randrange(6, 11))) for _ in range(7000)]
    groups = [words[:4000], words[3000:]]
    rows = [(5 * i + 1, " ".join(groups[i % 2]) + f" only{i}", i % 2) for i in range(24)]
    rows = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_kn.train(docs, docs.select("doc_id", "toxic"), sample_size=1)
    assert model.root > 150_000
    fits = toxicity_kn._labelled(docs, docs.select("doc_id", "toxic"), 1).filter("fits").collect()
    seen = [Counter(w for x in fits if x["toxic"] == c for w in set(x["text"].split())) for c in (0, 1)]
    n, order = [Counter(), Counter()], toxicity_kn.ORDER
    for w in seen[0].keys() | seen[1].keys():
        if seen[0][w] + seen[1][w] >= toxicity_kn.LEAST_TEXTS:
            s = "\x02" + w + "\x03"
            for i in range(1, len(s)):
                for k in range(max(0, i - order + 1), i + 1):
                    for c in (0, 1):
                        n[c][s[k : i + 1]] += seen[c][w]
    held = {g for g in n[0].keys() | n[1].keys() if n[0][g] + n[1][g] >= toxicity_kn.MIN_COUNT}
    assert model.root == len(held) + 1
    single = {g: n[0][g] + n[1][g] + 1 for g in held if len(g) == 1}
    models = []
    for c in (0, 1):
        lower, followers = Counter(), defaultdict(list)
        for g in n[c]:
            lower[g[1:]] += n[c][g] > 0
        count = {g: n[c][g] if len(g) == order or g[0] == "\x02" else lower[g] for g in n[c]}
        for g, x in count.items():
            followers[g[:-1]].append(x)
        models.append((count, {h: (sum(x), sum(v > 0 for v in x)) for h, x in followers.items()}))

    def chance(c, g):
        """Of the last character after the others, by the longest string of all characters but the last that is held."""
        if len(g) == 1:
            return single[g] / sum(single.values())
        count, heads = models[c]
        total, kinds = heads.get(g[:-1], (0, 0))
        share = max(count.get(g, 0) - toxicity_kn.DISCOUNT, 0) / total if total and g in held else 0
        return share + (toxicity_kn.DISCOUNT * kinds / total if total else 1) * chance(c, g[1:])

    def ratio(word):
        s, out = "\x02" + word + "\x03", 0.0
        for i in range(1, len(s)):
            k = max(0, i - order + 1)
            while s[k:i] not in held and s[k:i] != "\x02" and k < i:
                k += 1
            out += math.log(chance(1, s[k : i + 1]) / chance(0, s[k : i + 1])) if k < i else 0.0
        return out

    tried = words[::50] + ["abc", "l" * 30, "".join(words[:40]), words[5] + "kk", "a"]
    got = model.ratios(tried)
    assert np.allclose(got, [ratio(w) for w in tried], atol=1e-3)


def test_ids_of_arrow_texts_look_at_different_chunks_once():
    """Texts come as Arrow arrays; the cache meets each different chunk of them once, and ids are the tokenizer's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, seen = hilbert_packing.Ids(path), []

    class Chunks(dict):
        def __getitem__(self, c):
            seen.append(c)
            return super().__getitem__(c)

    ids.chunks = Chunks()
    texts = [" Zwölf  ÉTÉ's x1,23 \x85 été\x1codd\n", "", "word " * 5000 + "İstanbul <|endoftext|> ŉ ﬁ"] + ["word été's word,"] * 500
    ids.of(pa.array(["word été's word,"], pa.large_string()))  # learnt
    seen.clear()
    assert len(ids.of(pa.array(["word été's word,"] * 700, pa.large_string()))) == 700 and len(seen) == 3
    want = [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.of(pa.array(texts, pa.large_string()).slice(0)) == want == ids.of(texts)
    assert ids.of(pa.array(texts, pa.large_string()).slice(1, 2)) == want[1:3]
