"""Toxicity by class-conditional Kneser-Ney models: a text's score compares its length-normalised log-likelihood under
a model of toxic texts with that under one of ordinary texts.

The models are of characters within words, so they know inflected and misspelt forms of what they have seen. Each
interpolates discounted counts of up to ORDER characters, the beginning and the end of the word included, with lower
orders by Kneser-Ney's continuation counts; the lowest, single characters, is one distribution that both share, so a
string that neither class knows weighs next to nothing. A class counts a word once for each distinct text, so copies
and repetition don't pass for evidence.

The counts come from all labelled texts outside the held-out fold but those that fit the logistic curve, which turns
likelihood ratios into a score: at most SAMPLE texts of each class, drawn by a hash among one half of the texts. Words of
fewer than LEAST_TEXTS texts tell of a text, not of a class, and aren't counted; nor are strings of fewer than MIN_COUNT
counts. All others are sent to the executors, so what is sent grows with the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import EDGE, hold, materialise, text_or_empty

SAMPLE = 1500
DISCOUNT = 0.75
ORDER = 12
#: A word is counted from so many texts on, a string is kept from so many counts on.
LEAST_TEXTS, MIN_COUNT = 2, 4
#: A word this much likelier (in natural logarithms) among toxic texts counts as one in favour.
TELLING = 2.5
FOLDS = 5
CACHED_WORDS = 300_000
BEGIN, END = "\x02", "\x03"


def held_out(doc_id):
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id isn't held out, and has no label to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for w in (c.strip(EDGE) for c in text.lower().split()) if w]


def _labelled(texts: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic, fits): the distinct labelled texts that may be learnt from; those that don't fit the models, at most
    `size` a class, fit the curve."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = texts.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("h"), F.md5(F.col("text").cast("binary")).alias("m"))
    # equal texts are told by their hashes, so texts are shuffled once
    one = texts.select("doc_id", "h", "m").join(known.filter(~held_out(F.col("doc_id"))), "doc_id")
    one = materialise(one.groupBy("h", "m", "toxic").agg(F.min("doc_id").alias("doc_id")), "tox-distinct").hint("merge")
    rows = texts.join(one, ["doc_id", "h", "m"]).groupBy("doc_id", "h", "m", "toxic").agg(F.first("text").alias("text"))
    rows = materialise(rows.select("text", "toxic", "h"), "tox-labelled")
    drawn = F.lit(False)
    for k in (0, 1):
        last = rows.filter((F.col("toxic") == k) & (F.pmod("h", F.lit(2)) == 1)).select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
        if last is not None:
            drawn |= (F.col("toxic") == k) & (F.pmod("h", F.lit(2)) == 1) & (F.col("h") <= last)
    return rows.select("text", "toxic", (~drawn).alias("fits"))


def _word_counts(sample: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, n0, n1): in how many distinct texts of each class a word is found."""

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in set(words_of(text)):
                    held.setdefault(word, [0, 0])[toxic] += 1
                if len(held) >= flush:
                    yield _counted("word", held)
                    held.clear()
        if held:
            yield _counted("word", held)

    rows = sample.filter("fits AND toxic IN (0, 1)").select("text", "toxic").mapInArrow(run, "word string, n0 long, n1 long")
    return rows.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _counted(name: str, held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], [name, "n0", "n1"])


def _strings(words: DataFrame, flush: int = 300_000) -> DataFrame:
    """(gram, n0, n1): counts of the strings of 1 to ORDER characters in the words, without those of the beginning alone."""

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for word, n0, n1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = BEGIN + word + END
                for i in range(1, len(s)):
                    for k in range(max(0, i - ORDER + 1), i + 1):
                        got = held.get(s[k : i + 1])
                        if got is None:
                            held[s[k : i + 1]] = [n0, n1]
                        else:
                            got[0] += n0
                            got[1] += n1
                if len(held) >= flush:
                    yield _counted("gram", held)
                    held.clear()
        if held:
            yield _counted("gram", held)

    rows = words.mapInArrow(run, "gram string, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _models(grams: DataFrame) -> DataFrame:
    """(gram, head, last, size, a0, a1, l0, l1) of all strings of MIN_COUNT counts or more: hashes of the string and of all but
    its last character; its last character and its length; by class the discounted share of its last
    character after the others, and the weight of the next lower order where the whole string stands before."""
    follow = grams.filter("length(gram) > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"k{c[1]}") for c in ("n0", "n1")]
    )
    raw = (F.length("gram") == ORDER) | F.col("gram").startswith(BEGIN)
    counts = grams.join(follow, "gram", "left").select(
        "gram", (F.col("n0") + F.col("n1")).alias("n"), *[F.when(raw, F.col(f"n{c}")).otherwise(F.coalesce(f"k{c}", F.lit(0))).alias(f"c{c}") for c in "01"]
    )
    counts = materialise(counts, "tox-strings")
    before = F.expr("substring(gram, 1, length(gram) - 1)")
    heads = counts.groupBy(before.alias("head")).agg(
        *[F.sum(f"c{c}").alias(f"t{c}") for c in "01"], *[F.sum((F.col(f"c{c}") > 0).cast("long")).alias(f"d{c}") for c in "01"]
    )
    heads = materialise(heads, "tox-heads")
    kept = counts.filter((F.col("n") >= MIN_COUNT) & (F.col("gram") != BEGIN)).withColumn("head", before)
    share = [F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0).alias(f"a{c}") for c in "01"]
    rows = kept.join(heads, "head").select("gram", *share)
    rows = rows.union(heads.filter(F.col("head") == BEGIN).select("head", F.lit(0.0), F.lit(0.0)))
    weight = [F.when(F.col(f"t{c}") > 0, DISCOUNT * F.col(f"d{c}") / F.col(f"t{c}")).otherwise(1.0).cast("float").alias(f"l{c}") for c in "01"]
    rows = rows.join(heads.withColumnRenamed("head", "gram"), "gram", "left")
    return rows.select(
        F.xxhash64("gram").alias("gram"), F.xxhash64(before).alias("head"),
        F.ascii(F.expr("substring(gram, -1)")).alias("last"), F.length("gram").cast("byte").alias("size"), *[F.col(f"a{c}").cast("float").alias(f"a{c}") for c in "01"], *weight,
    )


class Model:
    """Both classes' strings as an automaton, and the logistic curve over what they say of a text.

    A state is a string that the models hold, the longest one that ends what was read; with each come its last character and
    the state before that (so a hash table finds a state's successors), what it adds, and the state of all but its first
    character with what falling back to that adds. All are arrays, some 30 bytes a string, and words are read many at a time.
    """

    SIZE = 5
    #: Characters of a word that are read in one go; a longer one's pieces begin with the ORDER - 1 characters before.
    PIECE = 64

    def __init__(self, strings: pa.Table | None = None, single: dict[str, int] | None = None):
        """strings: rows of _models; single: how often each character is counted."""
        self.weights, self.sent = np.zeros(self.SIZE), None
        self.known: dict[str, float] = {}
        self.root = n = strings.num_rows if strings else 0
        if not n:
            return
        got = {c: strings[c].to_numpy() for c in strings.column_names}
        del strings
        order = np.argsort(got["gram"]).astype(np.int32)
        gram, head, size = got.pop("gram")[order], got.pop("head"), got.pop("size")
        if (gram[1:] == gram[:-1]).any():
            raise ValueError("two strings of the models have one hash")
        at = np.minimum(np.searchsorted(gram, head), n - 1).astype(np.int32)
        before = np.where((size > 1) & (gram[at] == head), order[at], n).astype(np.int32)
        del order, gram, head, at
        # by length, then by what stands before the last character, then by that
        new, rows = np.full(n + 1, n, np.int32), []
        self.levels = np.append(0, np.cumsum(np.bincount(size, minlength=ORDER + 1)[1:]))
        for k in range(1, ORDER + 1):
            i = np.flatnonzero(size == k)
            rows.append(i[np.lexsort((got["last"][i], new[before[i]]))])
            new[rows[-1]] = np.arange(self.levels[k - 1], self.levels[k])
        rows = np.concatenate(rows)
        self.before, self.last = new[before[rows]], got.pop("last")[rows]
        self.begin = int(np.searchsorted(self.last[: self.levels[1]], ord(BEGIN)))
        del before, size, new
        self._index()
        a0, a1, l0, l1 = (np.append(got.pop(c)[rows], x).astype(np.float32) for c, x in (("a0", 0), ("a1", 0), ("l0", 1), ("l1", 1)))
        # probabilities of the last character by rising order, from the single characters that both classes share
        codes = np.array(sorted(map(ord, single)), np.int32)
        whole = sum(single.values()) + len(single)
        shares = np.array([(single[chr(c)] + 1) / whole for c in codes.tolist()])
        p0 = np.full(n + 1, 1e-6)
        own = self.last[: self.levels[1]]
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        p0[: len(own)] = np.where(codes[at] == own, shares[at], 1e-6)
        p1 = p0.copy()
        for k in range(2, ORDER + 1):
            i = slice(self.levels[k - 1], self.levels[k])
            p0[i], p1[i] = (a[i] + w[self.before[i]] * p[self.tail[i]] for a, w, p in ((a0, l0, p0), (a1, l1, p1)))
        self.gain = np.log(p1[:-1] / p0[:-1]).astype(np.float32)
        self.fall = np.log(l1 / l0).astype(np.float32)

    def _index(self):
        """The hash table of successors, and the states that follow from it."""
        n = self.root
        self.slots = np.full(1 << max(4, int(1.5 * n).bit_length()), -1, np.int32)
        waiting = np.arange(n, dtype=np.int32)
        at = self._slot(self.before, self.last)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & (len(self.slots) - 1)
        self.tail = np.full(n + 1, n, np.int32)
        for i, j in zip(self.levels[1:-1], self.levels[2:], strict=True):
            found = self._after(self.tail[self.before[i:j]], self.last[i:j])
            self.tail[i:j] = np.where(found < 0, n, found)
        # no state is longer than what an order has before its last character
        self.next = np.arange(n + 1, dtype=np.int32)
        self.next[self.levels[ORDER - 1] : n] = self.tail[self.levels[ORDER - 1] : n]

    def _slot(self, state: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = (state.astype(np.uint64) << np.uint64(21) | last.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _after(self, state: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The string of each state and the character behind it, -1 if the models don't hold it."""
        at = self._slot(state, last)
        out = self.slots[at]
        miss = np.flatnonzero((out >= 0) & ((self.before[out] != state) | (self.last[out] != last)))
        while len(miss):
            at[miss] = (at[miss] + 1) & (len(self.slots) - 1)
            found = out[miss] = self.slots[at[miss]]
            miss = miss[(found >= 0) & ((self.before[found] != state[miss]) | (self.last[found] != last[miss]))]
        return out

    def __getstate__(self):
        """What the rest follows from, packed: it lies on the disk of every executor."""
        state = {"weights": self.weights, "root": self.root}
        if self.root:
            steps = np.diff(self.before, prepend=np.int32(0))
            packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (steps, self.last, self.gain, self.fall)]
            state |= {"levels": self.levels, "begin": self.begin, "packed": packed}
        return state

    def __setstate__(self, state):
        packed = state.pop("packed", None)
        self.__dict__ |= state
        self.known, self.sent = {}, None
        if packed:
            sizes = [4 * self.root] * 3 + [4 * self.root + 4]
            kinds = (np.int32, np.int32, np.float32, np.float32)
            steps, self.last, self.gain, self.fall = (np.frombuffer(pa.decompress(x, m, "zstd", asbytes=True), t) for x, m, t in zip(packed, sizes, kinds, strict=True))
            self.before = np.cumsum(steps, dtype=np.int32)
            self._index()

    def everywhere(self, spark: SparkSession):
        """The model as executors get it, sent once; its weights may be those of another time."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary): along the longest strings that the models hold."""
        if not self.root or not words:
            return np.zeros(len(words))
        codes = np.frombuffer("".join([w + END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        pieces = -(-size // self.PIECE)
        of = np.repeat(np.arange(len(words)), pieces)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * self.PIECE
        skip = np.minimum(at, ORDER - 1)
        size = np.minimum(size[of] - at, self.PIECE) + skip
        order = np.argsort(-size, kind="stable")
        of, first, skip, size = of[order], (start[of] + at - skip)[order], skip[order], size[order]
        state = np.where(skip > 0, self.root, self.begin).astype(np.int32)
        # a word's first piece has nothing to skip
        total = np.zeros(len(of))
        for t in range(int(size[0])):
            here = np.arange(np.searchsorted(-size, -t, "left"))
            c, own = codes[first[here] + t], state[here]
            counts = None if not skip.any() else t >= skip[here]
            while len(here):
                found = self._after(own, c)
                hit = found >= 0
                i = here[hit]
                total[i] += self.gain[found[hit]] if counts is None else self.gain[found[hit]] * counts[hit]
                state[i] = self.next[found[hit]]
                more = ~hit & (own != self.root)
                state[here[~hit & ~more]] = self.root
                here, c, own = here[more], c[more], own[more]
                total[here] += self.fall[own] if counts is None else self.fall[own] * counts[more]
                counts = counts if counts is None else counts[more]
                own = self.tail[own]
        return np.bincount(of, total, len(words))

    def measures(self, texts: list[str], many: int = 256) -> np.ndarray:
        """A row a text: 1; the mean log-ratio of its words; its best word's; its best three words' mean; how many words tell, damped."""
        out = np.zeros((len(texts), self.SIZE))
        out[:, 0] = 1
        known = self.known
        for i in range(0, len(texts), many):
            if len(known) > CACHED_WORDS:
                known.clear()
            split = [t.split() for t in texts[i : i + many]]
            new = list(set().union(*split).difference(known))
            words = [c.lower().strip(EDGE) for c in new]
            known.update(zip(new, np.where([w != "" for w in words], self.ratios(words), 0.0).tolist(), strict=True))
            for k, chunks in enumerate(split, i):
                if chunks:
                    r = np.fromiter(map(known.__getitem__, chunks), float, len(chunks))
                    best = np.sort(np.partition(r, max(0, len(r) - 3))[-3:])[::-1]
                    out[k, 1:] = r.mean(), best[0], best.sum() / 3, math.log1p((r > TELLING).sum())
            for c in new:
                if len(c) > 64:
                    del known[c]
        return out

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ weights, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2, steps: int = 50) -> None:
        """Logistic regression by Newton's steps; the classes count by their share among the labels, the intercept is free."""
        if not len(y) or y.min() == y.max():
            share = min(max(prior, 1e-6), 1 - 1e-6)
            self.weights = np.array([math.log(share / (1 - share)), 0, 0, 0, 0])
            return
        each = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
        b, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            gradient = x.T @ (each * (p - y)) + penalty @ b
            curve = (x * (each * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(b))
            step = np.linalg.solve(curve, gradient)
            b -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = b


def train(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> Model:
    """The model that the labelled rows outside the held-out fold give; see the module for its bounds.

    Without labels of both classes every text scores their share (one half without any label).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = _labelled(texts, labels, sample_size)
    share = labels.filter("toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = 0.5 if share is None else share
    words = materialise(_word_counts(sample).filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS), "tox-words")
    seen = words.agg(F.sum("n0"), F.sum("n1")).first()
    if not seen[0] or not seen[1]:
        model = Model()
        model.fit(np.zeros((0, Model.SIZE)), np.zeros(0), prior)
        return model
    grams = materialise(_strings(words), "tox-grams")
    single = {r["gram"]: r["n0"] + r["n1"] for r in grams.filter("length(gram) = 1").collect()}
    model = Model(_models(grams).toArrow(), single)
    sent = model.everywhere(docs.sparkSession)

    def measured(batches):
        for batch in batches:
            x = sent.value.measures(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(Model.SIZE)), batch.column(1)], ["a", "b", "c", "d", "e", "y"])

    got = sample.filter("NOT fits").select("text", F.col("toxic").cast("double")).mapInArrow(measured, "a double, b double, c double, d double, e double, y double")
    data = np.array([tuple(r) for r in got.collect()]).reshape(-1, Model.SIZE + 1)
    model.fit(data[:, :-1], data[:, -1], prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted; they depend on the text alone. A null text is an empty one.

    Repeated rows score alike; an empty table gives an empty one; columns of docs named score or predicted give way.
    """
    sent, weights = model.everywhere(docs.sparkSession), model.weights

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        hold("toxicity", sent.value.known.clear)
        return pa.array(sent.value.scores(text.to_pylist(), weights), pa.float64())

    d = docs.drop("score", "predicted").withColumn("score", scored(text_or_empty()))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs with held_out, score and predicted, by a model of the labels."""
    d = score(docs, train(docs, labels, **bounds))
    return d.withColumn("held_out", held_out(F.col("doc_id")))
