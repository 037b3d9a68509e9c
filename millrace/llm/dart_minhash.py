"""Near-duplicate documents by DartMinHash: weighted signatures from hashed darts, joined by bands.

Each shingle owns a strip as wide as its count in the text. Darts, placed by hashes of the shingle and the unit cell
of (weight, rank) that they land in, fall on the strips with density 1; each names one of k coordinates, and a
coordinate's value is the dart of earliest rank. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity. Only about k ln k darts are thrown at a text, however long it is: ranks are looked at in
rising order until every coordinate is hit.

Texts that share a band of coordinates are candidates, and candidates are compared by all their shingles. Inside a
band's bucket everyone is first compared with two leaders; components of what proves alike are then found. Buckets that
still hold several components meet other leaders, in ROUNDS rounds. What is mixed then is compared in full: in each
bucket the rows outside its largest component meet all its rows, by signature and then by shingles, and a row yields
one link to each component that it proves alike to. Rows are dealt out in blocks, and a task has two blocks at most. So a
crowd of copies costs a few comparisons each and no group is written out in pairs. Of the pairs that share a bucket, a
signature rules out only those that agree in fewer coordinates than a pair at the threshold does with probability LOST.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import WordCodes, hold, materialise, mix64, shingle_codes, text_or_empty
from millrace.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: The probability that the signatures of a pair at the threshold agree in too few coordinates for it to be looked at.
LOST = 1e-9
#: Rounds of further leaders, leaders a round, and the rows of a bucket that one task compares.
ROUNDS, LEADERS = 1, 2
BLOCK = 2048

_U = np.uint64
#: Chances that a cell of area 1 holds up to 0, 1, 2, ... darts.
_DARTS = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(18)])


@lru_cache(maxsize=1)
def _words() -> WordCodes:
    return WordCodes()


def _codes(text: str) -> np.ndarray:
    codes = _words().codes(text)
    return codes[codes != 0]


def _name(codes: np.ndarray, text: str) -> bytes:
    """128 bits that name a sequence of words; a text without any is named by its characters."""
    return hashlib.md5(codes.tobytes() if len(codes) else b"raw" + text.encode()).digest()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit codes of the text's WIDTH-word shingles, ascending, and their counts."""
    return np.unique(shingle_codes(_codes(text), WIDTH), return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k 64-bit values: rank and name of each coordinate's earliest dart. weights are positive, whole or not."""
    cells = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), cells)
    step = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    strips = mix64(elements[at] + step.astype(_U) * _U(0x9E3779B97F4A7C15))
    room = (weights[at] - step).astype(float)
    darts_wanted = k * math.log(k) + 2 * k
    out = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    rank, ranks = 0, max(1, math.ceil(darts_wanted / float(weights.sum())))
    empty = True
    while empty:
        levels = np.arange(rank, rank + ranks, dtype=np.uint64)
        cell = mix64(strips[:, None] + (levels[None, :] + _U(1)) * _U(0xD1B54A32D192ED03)).ravel()
        n = np.searchsorted(_DARTS, (cell >> _U(11)).astype(float) / 2.0**53, side="right")
        which = np.repeat(np.arange(len(cell)), n)
        number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(cell[which] + (number.astype(_U) + _U(1)) * _U(0x8CB92BA72F3D8DD7))
        place = mix64(dart + _U(1))
        if (room < 1).any():
            inside = (place >> _U(40)).astype(float) / 2.0**24 < np.repeat(room, ranks)[which]
            dart, place, which = dart[inside], place[inside], which[inside]
        level = levels[which % ranks] if len(which) else levels[:0]
        value = (level << _U(44)) | (dart >> _U(20))
        np.minimum.at(out, ((place & _U(0xFFFFFFFF)) % _U(k)).astype(np.int64), value)
        empty = bool((out == np.iinfo(np.uint64).max).any())
        rank += ranks
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = signature.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key + grid[:, r])
    return key.view(np.int64)


def weighted_jaccard(a, m, b, n) -> float:
    """Of two shingle sets with counts: what they share, by the smaller count, over what either has, by the larger."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(m[i], n[j]).sum()
    whole = m.sum() + n.sum() - shared
    return float(shared / whole) if whole else 1.0


SCAN = "doc_id long, k1 long, k2 long, n long, bands array<long>, sig binary"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, bands, sig): a name of the text's shingle sequence, its length, band keys, 16 bits a coordinate.

    Texts without a word have no band; their name is that of their characters.
    """

    def run(batches):
        hold("dart", _words().clear)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = _codes(text)
                name = _name(codes, text)
                if len(codes):
                    elements, counts = np.unique(shingle_codes(codes, WIDTH), return_counts=True)
                    sig = dart_signature(elements, counts, BANDS * ROWS)
                    bands, low = band_keys(sig).tolist(), mix64(sig).astype(np.uint16).tobytes()
                    n = int(counts.sum())
                else:
                    bands, low, n = [], b"", 0
                k1, k2 = np.frombuffer(name, np.int64).tolist()
                rows.append((doc_id, k1, k2, n, bands, low))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "k1", "k2", "n", "bands", "sig"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCAN)


def least_agreeing(k: int = BANDS * ROWS, likeness: float = THRESHOLD, lost: float = LOST) -> int:
    """The largest m for which k coordinates, each equal with probability `likeness`, agree in fewer than m with probability `lost` or less."""
    below, m = 0.0, 0
    while below + (here := math.comb(k, m) * likeness**m * (1 - likeness) ** (k - m)) <= lost:
        below, m = below + here, m + 1
    return m


def _near_in_size(n, m):
    return F.least(n, m) >= THRESHOLD * F.greatest(n, m) - 1e-9


def _held(e: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle codes and counts as _sets writes them; codes that share their high half are one."""
    codes = np.frombuffer(e, "<u4")
    counts = np.frombuffer(c, "<u4").astype(np.int64) if c else np.ones(len(codes), np.int64)
    if len(codes) > 1 and (codes[1:] == codes[:-1]).any():
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, counts = codes[first], np.add.reduceat(counts, first)
    return codes, counts


def _alike(a, b) -> bool:
    return weighted_jaccard(*a, *b) >= THRESHOLD - 1e-9


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, k1, e, c) of the needed (id) texts: the first half of their names, the high halves of their shingle codes, and the
    counts where they aren't all 1. An id has a row for each of its texts."""

    def read(batches):
        hold("dart", _words().clear)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([np.frombuffer(_name(_codes(t), t), np.int64)[0] for t in texts], pa.int64()),
                    pa.array([(e >> _U(32)).astype("<u4").tobytes() for e, _ in found], pa.binary()),
                    pa.array([b"" if (c == 1).all() else c.astype("<u4").tobytes() for _, c in found], pa.binary()),
                ],
                ["id", "k1", "e", "c"],
            )

    needed = materialise(needed.distinct(), "near-needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(needed.hint("merge"), "id", "left_semi")
    return materialise(texts.mapInArrow(read, "id long, k1 long, e binary, c binary").dropDuplicates(["id", "k1"]), "near-sets")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) whose weighted Jaccard similarity is THRESHOLD or more. Only texts in a pair are read into shingles."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def compare(batches):
        for batch in batches:
            a, b, ea, ca, eb, cb = (x.to_pylist() for x in batch.columns)
            keep = [_alike(_held(w, x), _held(y, z)) for w, x, y, z in zip(ea, ca, eb, cb, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(col, keep, strict=True) if k], pa.int64()) for col in (a, b)], ["a", "b"]
            )

    one, two = (sets.select(F.col("id").alias(x), F.col("e").alias(f"e{x}"), F.col("c").alias(f"c{x}")).hint("merge") for x in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "ca", "eb", "cb")
    return joined.mapInArrow(compare, "a long, b long").distinct()


def _pairs(led: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, from (doc, n, l: struct of doc and n); pairs whose lengths rule them out are left out."""
    fit = led.filter((F.col("l.doc") != F.col("doc")) & _near_in_size(F.col("l.n"), F.col("n")))
    return materialise(fit.select(F.least("doc", "l.doc").alias("a"), F.greatest("doc", "l.doc").alias("b")).distinct(), "near-pairs")


def _mixed(in_bands: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, doc, n, component) of the buckets that hold more than one component."""
    placed = in_bands.join(parts.withColumnRenamed("node", "doc").hint("merge"), "doc", "left")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "doc")), "near-placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    return materialise(placed.join(materialise(mixed, "near-bands").hint("merge"), "band"), "near-mixed")


def _across(mixed: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that tie components of mixed buckets together, from all pairs of rows of a bucket that are in
    different components and share no earlier bucket.

    Rows outside a bucket's largest component are dealt out in `few` blocks, those of it in `many`: each block of the first
    kind meets each block of both, in a task of its own, so a task has 2 * BLOCK rows or so however large a bucket is.
    mixed is (band, doc, n, component), held (doc, k1, bands, sig).
    """
    sizes = mixed.groupBy("band", "component").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("m", "component")).alias("x"), F.sum("m").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = materialise(sizes.select("band", F.col("x.component").alias("largest"), blocks(F.col("all") - F.col("x.m")).alias("few"), blocks(F.col("x.m")).alias("many")), "near-sizes")
    d = materialise(mixed.join(sizes.hint("merge"), "band"), "near-blocks")
    d = d.withColumn("small", F.col("component") != F.col("largest"))
    d = d.withColumn("own", F.pmod(F.xxhash64("doc"), F.when(F.col("small"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(up_to("few"), lambda k: cell(0, F.least("own", k), F.greatest("own", k)))
    against = F.transform(up_to("many"), lambda k: cell(1, F.col("own"), k))
    d = d.withColumn("cell", F.explode(F.when(F.col("small"), F.concat(among, against)).otherwise(F.transform(up_to("few"), lambda k: cell(1, k, F.col("own"))))))
    sets = _sets(docs, mixed.select(F.col("doc").alias("id"))).withColumnRenamed("id", "doc")
    facts = materialise(held.select("doc", "k1", "bands", "sig").join(sets.hint("merge"), ["doc", "k1"]).drop("k1"), "near-facts")
    d = d.select("band", "cell.*", "own", "small", "doc", "n", "component").join(facts.hint("merge"), "doc").filter(F.array_contains("bands", F.col("band")))
    least = least_agreeing()

    def compare(table):
        kind, i, j, band = (table.column(c)[0].as_py() for c in ("kind", "i", "j", "band"))
        own, small, doc, n, part = (table.column(c).to_numpy() for c in ("own", "small", "doc", "n", "component"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(doc), -1)
        here = int(np.flatnonzero(bands[0] == band)[0])
        sets = [None] * len(doc)

        def shingles_of(r):
            if sets[r] is None:
                sets[r] = _held(table.column("e")[r].as_py(), table.column("c")[r].as_py())
            return sets[r]

        links = []
        others = ~small if kind else own == j
        for x in np.flatnonzero(small & (own == i)):
            y = np.flatnonzero(others & (part != part[x]) & ((doc > doc[x]) if not kind and i == j else True))
            lo, hi = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            y = y[lo >= THRESHOLD * hi - 1e-9]
            near = (sig[y] == sig[x]).sum(1)
            y, near = y[near >= least], near[near >= least]
            y = y[np.argsort(-near, kind="stable")]
            y = y[~(bands[y, :here] == bands[x, :here]).any(1)] if here else y
            tied = set()
            for v in y:
                if part[v] not in tied and _alike(shingles_of(x), shingles_of(v)):
                    tied.add(part[v])
                    links.append((min(int(doc[x]), int(doc[v])), max(int(doc[x]), int(doc[v]))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return d.groupBy("band", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (doc_id, representative, class_id) for every row, links the (a, b) of alike texts.

    Rows of equal word sequences have one representative, their least doc_id; representatives whose shingles are
    THRESHOLD alike are linked, and a class, named by its least doc_id, is what links connect. Null texts are empty; texts
    without words are alike only if equal; texts of fewer words than a shingle has are one shingle. Rows with a null
    doc_id join the class of their text but name none. Rows that share a doc_id and differ in text are compared each,
    and are one class. An empty table gives empty ones; other columns are left out. Very long texts are read whole. The links
    span the classes: not every alike pair is among them.
    """
    scan = materialise(signatures(docs), "near-scan")
    reps = scan.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "bands", "sig")).alias("r"))
    reps = materialise(reps.select("k1", "k2", F.col("r.doc_id").alias("doc"), "r.n", "r.bands", "r.sig"), "near-reps")
    held = reps.filter("doc IS NOT NULL")
    in_bands = held.select(F.explode("bands").alias("band"), "doc", "n")
    both = F.struct("doc", "n")

    def by_hash(salt: int):
        return F.min(F.struct(F.xxhash64(F.lit(salt), "doc").alias("h"), both.alias("l")))

    leaders = in_bands.groupBy("band").agg(F.min(both).alias("x"), by_hash(0).alias("y"), F.count("*").alias("m")).filter("m > 1")
    leaders = materialise(leaders.select("band", F.array("x", "y.l").alias("ls")), "near-leaders")
    crowded = materialise(in_bands.join(leaders.hint("merge"), "band"), "near-crowded")
    pairs = _pairs(crowded.select("doc", "n", F.explode("ls").alias("l")))
    links = materialise(_verified(pairs, docs), "near-links")
    parts = materialise(components(links), "near-parts")
    mixed = _mixed(crowded.select("band", "doc", "n"), parts)
    for k in range(ROUNDS):
        found = [by_hash(1 + k * LEADERS + j).alias(f"l{j}") for j in range(LEADERS)]
        leaders = materialise(mixed.groupBy("band").agg(*found).select("band", F.array(*[f"l{j}.l" for j in range(LEADERS)]).alias("ls")), "near-leaders")
        whole = mixed.join(leaders.hint("merge"), "band").select("doc", "n", "component", F.explode("ls").alias("l"))
        theirs = parts.select(F.col("node").alias("_of"), F.col("component").alias("_led")).hint("merge")
        apart = whole.join(theirs, F.col("l.doc") == F.col("_of"), "left").filter(F.coalesce("_led", "l.doc") != F.col("component"))
        new = _pairs(apart.select("doc", "n", "l")).join(pairs.hint("merge"), ["a", "b"], "left_anti")
        new = materialise(new, "near-pairs")
        if new.isEmpty():
            break
        pairs = materialise(pairs.unionByName(new), "near-pairs")
        links = materialise(links.unionByName(_verified(new, docs)), "near-links")
        parts = materialise(components(links), "near-parts")
        mixed = _mixed(mixed.select("band", "doc", "n"), parts)
    if not mixed.isEmpty():
        links = materialise(links.unionByName(_across(mixed, held, docs)).distinct(), "near-links")
        parts = materialise(components(links), "near-parts")
    classes = reps.join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    classes = materialise(classes.select("k1", "k2", "doc", F.coalesce("component", "doc").alias("class_id")), "near-classes")
    members = scan.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])
    return members.select("doc_id", F.col("doc").alias("representative"), "class_id"), links


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id of its class."""
    return near_duplicates(docs)[0].select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one whose doc_id names it. Rows without a doc_id stay, and so do repeats of a row that stays."""
    members, _ = near_duplicates(docs)
    gone = materialise(members.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
