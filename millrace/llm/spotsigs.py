"""SpotSigs fingerprints: each common word anchors a chain of the content words behind it, and the set of hashed
chains is the text's fingerprint. Sets are partitioned by length and compared through pruned Jaccard.
"""

from __future__ import annotations

import base64
import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import WordCodes, common_words, hold, materialise, mix64, shingle_codes, shuffle_partitions, text_or_empty

CHAIN = 2
DISTANCE = 1
THRESHOLD = 0.8
_CONTENT = np.uint64(1 << 63)


@lru_cache(maxsize=1)
def _words() -> WordCodes:
    return WordCodes(special={w: k + 1 for k, w in enumerate(common_words())})


def signature(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """The sorted set of the text's chains, as 32-bit hashes.

    An anchor is a common word, or the beginning of the text; its chain is the next `chain` content words, each
    `distance` content words further. Chains that the text ends in are left out, except the first anchor's. A text
    without content words has one hash of its common words, one without words one of its characters, an empty one none.
    """
    codes = _words().codes(text)
    codes = codes[codes != 0]
    if not len(codes):
        raw = "".join(text.split())
        return np.array([int.from_bytes(hashlib.md5(raw.encode()).digest()[:4], "little")] if raw else [], np.uint32)
    is_content = codes >= _CONTENT
    content = codes[is_content]
    if not len(content):
        return np.array([int(shingle_codes(codes, len(codes))[0]) >> 32], np.uint32)
    after = np.cumsum(is_content)[~is_content]
    anchors = codes[~is_content]
    whole = after + (chain - 1) * distance < len(content)
    after, spots = after[whole], mix64(anchors[whole])
    first = np.zeros(1, np.uint64)
    for k in range(chain):
        spots = mix64(spots + content[after + k * distance])
        first = mix64(first + content[min(k * distance, len(content) - 1)])
    return np.unique((np.append(spots, first) >> np.uint64(32)).astype(np.uint32))


def fingerprint(sig: np.ndarray) -> str:
    """The set as text: base64 of the sorted hashes, each a little-endian unsigned 32-bit integer."""
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a comparison where their lengths rule `threshold` out.

    Two empty sets are alike, an empty and another set are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    short, long = sorted((len(a), len(b)))
    if short < threshold * long:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; null texts are empty."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(signature(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


#: Bounds of the stretches of doc_id: so many for each shuffle partition, and at most.
STRETCHES, MOST_STRETCHES = 8, 8192


def _stretches(docs: DataFrame) -> DataFrame:
    """docs as (stretch, ahead, place, doc_id, text): runs of neighbouring doc_ids, descending, each followed by a
    copy of the next run's first row (ahead), the last by one of the first's.

    Bounds and first rows are one number for each run, at most MOST_STRETCHES whatever the data.
    """
    n = min(MOST_STRETCHES, STRETCHES * shuffle_partitions(docs.sparkSession))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), text_or_empty().alias("text"))
    marks = [k / n for k in range(1, n)]
    bounds = np.array(sorted(set(d.agg(F.percentile_approx("place", marks, 100 * n).alias("b")).first()["b"] or [])), np.int64)

    @F.arrow_udf("int")
    def stretch_of(place: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, place.to_numpy(zero_copy_only=False)), pa.int32())

    d = d.withColumn("stretch", stretch_of("place"))
    heads = sorted((r["stretch"], r["head"]) for r in d.groupBy("stretch").agg(F.max("place").alias("head")).collect())
    leads = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}

    @F.arrow_udf("int")
    def led_by(place: pa.Array) -> pa.Array:
        return pa.array([leads.get(x) for x in place.to_pylist()], pa.int32())

    d = d.withColumn("led", led_by("place"))
    own = F.struct(F.col("stretch").alias("stretch"), F.lit(0).alias("ahead"))
    copy = F.struct(F.col("led").alias("stretch"), F.lit(1).alias("ahead"))
    both = F.when(F.col("led").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return d.select("doc_id", "place", "text", F.explode(both).alias("at")).select("at.stretch", "at.ahead", "place", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text with its last third of code points (rounded down) replaced by the first as many, or all, of following."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, and their likeness to each other
    and to the next document's, where the next has the next smaller doc_id and the smallest is followed by the largest.

    Null texts are empty; null doc_ids come after the smallest; rows that share a doc_id follow each other by text;
    a single row follows itself; an empty table gives an empty one; other columns are left out.
    """
    d = _stretches(docs).repartition("stretch").sortWithinPartitions("stretch", "ahead", F.desc("place"), "text")
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]

    def run(batches):
        hold("spotsigs", _words().clear)
        waiting = None  # stretch, doc_id, text, signature
        for batch in batches:
            rows = []
            stretches, aheads, _, ids, texts = (c.to_pylist() for c in batch.columns)
            for stretch, ahead, doc_id, text in zip(stretches, aheads, ids, texts, strict=True):
                if ahead and (waiting is None or waiting[0] != stretch):
                    continue
                sig = signature(text)
                if waiting and waiting[0] == stretch:
                    _, its_id, its_text, its_sig = waiting
                    changed = edited(its_text, text)
                    new = signature(changed)
                    rows.append(
                        (
                            its_id,
                            len(its_text),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            fingerprint(its_sig),
                            fingerprint(new),
                            likeness(its_sig, new),
                            likeness(its_sig, sig),
                        )
                    )
                waiting = None if ahead else (stretch, doc_id, text, sig)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return d.mapInArrow(run, EDIT_SCHEMA)


def near_pairs(prints: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of fingerprints at least `threshold` alike, from (doc_id, fingerprint).

    Equal fingerprints are one class, named by its smallest doc_id: members has (doc_id, class_id), pairs has
    (a, b, likeness) of classes, a < b. Empty fingerprints are one class and near no other.

    Sets are partitioned by length: two sets that are alike enough lie in one partition or in neighbours, so a set
    is stored in its own and looked up in its own and the one above. Within a partition two sets meet under a
    signature that is among the rarest of both (as many as it takes for alike sets to share one), and a pair is
    compared once, at the first they share; lengths prune before members are counted.
    """
    named = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    named = materialise(named, "spot-classes")
    members = prints.join(named, "fingerprint").select("doc_id", "class_id")

    @F.arrow_udf("array<long>")
    def decoded(fp: pa.Array) -> pa.Array:
        return pa.array([read_fingerprint(x).astype(np.int64).tolist() for x in fp.to_pylist()], pa.list_(pa.int64()))

    sets = named.filter("fingerprint <> ''").select("class_id", decoded("fingerprint").alias("sigs"))
    sets = sets.withColumn("n", F.size("sigs"))
    step = -math.log(threshold)
    sets = materialise(sets.withColumn("part", F.floor(F.log("n") / step).cast("int")), "spot-sets")
    spots = sets.select("class_id", "n", "part", F.explode("sigs").alias("sig"))
    rarity = materialise(spots.groupBy("sig").agg(F.count("*").alias("df")), "spot-rarity")
    ranked = spots.join(rarity, "sig").groupBy("class_id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("r"))
    prefix = F.expr(f"slice(r, 1, n - cast(ceil({threshold!r} * n - 1e-9) as int) + 1)")
    probes = ranked.select("class_id", "n", "part", F.posexplode(F.transform(prefix, lambda x: x.sig)).alias("at", "sig"))
    stored = probes.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("part"), "sig")
    looked = probes.select(
        F.col("class_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig"
    )
    met = stored.join(looked, ["part", "sig"]).filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    )
    met = met.select("a", "b").distinct()
    one, two = (sets.select(F.col("class_id").alias(x), F.col("sigs").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = met.join(one, "a").join(two, "b").withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    pairs = pairs.filter(F.col("likeness") >= threshold - 1e-12)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members
