"""Packing along a space-filling curve: documents are sorted by the Hilbert key of their projected word vectors,
and neighbours on the curve are packed into sequences one behind the other.

A document's vector counts its overlapping runs of 8 bytes, each hashed to a feature, and is projected to DIMENSIONS
random directions; a feature's part in each is a byte of its hash. Each coordinate, the mean over the runs, is squashed
to [0, 1), and the grid cell's place on the Hilbert curve is the key.
Rows are dealt out by ranges of (key, doc_id) of about equal bytes, so a crowd of equal texts spreads over tasks, and
each task packs its own stretch of the curve. Documents are cut wherever a sequence is full; what is left at the end of a stretch
is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import gc
import re
import zlib
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import hold, shuffle_partitions, text_or_empty

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 15
#: Bytes of a hashed run, the odd factor that hashes it, and how far means are apart that the curve tells well apart.
RUN, FACTOR, SPREAD = 8, np.uint64(0x9E3779B97F4A7C15), 3.0
SOME_BYTES = 2_000_000
#: Chunks that a worker keeps, bytes of texts (one at least) whose ids it works out at once.
CACHED_CHUNKS, BYTES_AT_ONCE = 800_000, 8_000_000

#: Python's split() takes these for white space; the tokenizers don't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Fixed value: how the vocabulary's pre-tokenizer splits lower-cased text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that lower-casing and normalisation take one by one: ASCII, and precomposed Latin letters but one.
_PLAIN = re.compile("[!-~À-įı-ɏ]+")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of n cells (n x dimensions, each coordinate of `bits` bits): Skilling's transform."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    zero = np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        p = np.uint64((1 << bit) - 1)
        for i in range(dims):
            on = (x[i] & q) != zero
            swap = np.where(on, zero, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> np.uint64(bit)) & np.uint64(1) != zero, np.uint64((1 << bit) - 1), zero)
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | (x[i] >> np.uint64(bit)) & np.uint64(1)
    return key


def project(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The coordinates of texts that lie one behind the other in data, as UTF-8; starts has one place more than texts."""
    spots = np.zeros((len(starts) - 1, DIMENSIONS))
    long = np.flatnonzero(np.diff(starts) >= RUN)
    if not len(long):
        return spots
    for some in np.array_split(long, max(1, int(np.diff(starts)[long].sum()) // SOME_BYTES)):
        first, last = int(starts[some[0]]), int(starts[some[-1] + 1])
        runs = np.ndarray(last - first - RUN + 1, "<u8", data[first:last].tobytes(), strides=(1,))
        features = ((runs * FACTOR) >> np.uint64(32)).astype("<u4").view(np.int8).reshape(-1, DIMENSIONS)
        begin, end = starts[some] - first, starts[some + 1] - first - RUN + 1
        total = np.add.reduceat(features, np.minimum(np.ravel(np.column_stack([begin, end])), len(features) - 1), axis=0, dtype=np.int64)[::2]
        if end[-1] == len(features):  # reduceat can't end behind the last run, so that run is missing
            total[-1] += features[-1]
        spots[some] = total / (end - begin)[:, None]
    return spots


def curve_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places on the curve. Texts of fewer bytes than a run lie in the middle."""
    unit = 1 / (1 + np.exp(-project(data, starts) / SPREAD))
    return hilbert_index(np.minimum(unit * (1 << BITS), (1 << BITS) - 1).astype(np.uint64), BITS).astype(np.int64)


def _curve_of(text: pa.Array) -> np.ndarray:
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, np.int64)
    _, starts, data = text.buffers()
    starts = np.frombuffer(starts, np.int64)[text.offset : text.offset + len(text) + 1]
    return curve_keys(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts)


@F.arrow_udf(T.LongType())
def curve_key(text: pa.Array) -> pa.Array:
    return pa.array(_curve_of(text), pa.int64())


#: Rows of the sample that balances the stretches, for each stretch; and stretches at most.
SAMPLED, MOST_STRETCHES = 50, 32_768


def _bounds(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(curve, doc_id) at which each stretch but the first begins, so that n stretches have about as many bytes each.

    They come from a sample of about SAMPLED rows a stretch, drawn by a hash. It decides on balance alone: every row is
    packed, wherever the bounds are.
    """
    rows = docs.count()
    if n < 2 or not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, SAMPLED * n / rows)
    coin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    drawn = docs.filter(coin).select(curve_key("text").alias("curve"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.length("text").alias("size"))
    drawn = sorted(tuple(r) for r in drawn.limit(4 * SAMPLED * n).collect())
    if not drawn:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.cumsum([r[2] + 40 for r in drawn])
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, n) / n))
    return tuple(np.array([drawn[k][c] for k in at], np.int64) for c in (0, 1))


def along_curve(docs: DataFrame) -> DataFrame:
    """(doc_id, text, curve) dealt out and sorted by the curve; ties go by doc_id, then by text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = min(shuffle_partitions(docs.sparkSession), MOST_STRETCHES)
    curves, ids = _bounds(d, n)

    @F.arrow_udf("struct<curve:long,stretch:int>")
    def place_of(text: pa.Array, place: pa.Array) -> pa.Array:
        curve, place = _curve_of(text), place.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(curves, curve, "left"), np.searchsorted(curves, curve, "right")
        for k in np.flatnonzero(lo < hi):  # on a bound: the ids of equal curves decide
            lo[k] += np.searchsorted(ids[lo[k] : hi[k]], place[k], "right")
        return pa.StructArray.from_arrays([pa.array(curve, pa.int64()), pa.array(lo, pa.int32())], ["curve", "stretch"])

    d = d.withColumn("at", place_of("text", F.coalesce("doc_id", F.lit(-(1 << 63))))).select("doc_id", "text", "at.curve", "at.stretch")
    return d.repartitionById(n, F.col("stretch")).sortWithinPartitions("curve", "doc_id", "text")


class Ids:
    """Ids of texts by a tokenizers file of lower-cased words with an end mark, split as PIECES says.

    White-space chunks, and the pieces of plain chunks, are encoded once and kept in one bounded cache: a piece is a chunk
    of its own. New pieces are encoded many at a time, by the merges alone: each piece ends in the one id that ends a word.
    Other chunks, and texts with characters that only Python calls white space, go through the tokenizer as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Tokenizer(self.tokenizer.model)  # plain pieces are normal and split already
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces_of = regex.compile(PIECES).findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        ids = np.array(self.merges.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(new) and (not len(last) or last[-1] == len(ids)):
            data, at = ids.tobytes(), [0, *(4 * last).tolist()]
            self.chunks.update(zip(new, [data[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        else:
            self.chunks.update(zip(new, self._encode(new), strict=True))

    def _learn(self, new: list[str]) -> None:
        words, more, odd = {}, {}, []  # chunks of one piece, of several, and those that the tokenizer has to see
        for c in new:
            if not _PLAIN.fullmatch(c):
                odd.append(c)
            elif c.isalpha():
                words[c] = c.lower()
            elif c[-1] in ".,;:!?" and c[:-1].isalpha():
                more[c] = (c[:-1].lower(), c[-1])
            elif "<|" in c:
                odd.append(c)
            else:
                more[c] = self.pieces_of(c.lower())
        missing = list(set(words.values()).union(*more.values()).difference(self.chunks))
        if missing:
            self._learn_pieces(missing)
        get = self.chunks.__getitem__
        self.chunks.update(zip(words, map(get, words.values()), strict=True))
        self.chunks.update(zip(more, [b"".join(map(get, found)) for found in more.values()], strict=True))
        if odd:
            self.chunks.update(zip(odd, self._encode(odd), strict=True))

    def of(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Chunks are told apart in Arrow; only different ones become Python's."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(texts, f"[{ODD_SPACE}]").to_numpy(zero_copy_only=False)).tolist()
        split = pc.utf8_split_whitespace(texts)  # the white space that Python's split() takes
        coded = split.flatten().dictionary_encode()
        different, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        if new := list(filterfalse(self.chunks.__contains__, different)):
            self._learn(new)
        found = list(map(self.chunks.__getitem__, different))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = (np.cumsum(sizes) - sizes)[which]
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        data = np.frombuffer(b"".join(found), "<u4")[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes[which])].tobytes()
        at = (4 * upto[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        ids = [data[i:j] for i, j in zip(at, at[1:], strict=False)]
        for k, whole in zip(odd, self._encode(texts.take(pa.array(odd, pa.int64())).to_pylist()), strict=True):
            ids[k] = whole
        return ids


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


class Packer:
    """Cuts ids into pieces that fill sequences of `length`; pieces of the open sequence are held until it is full."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length, self.fill = first_sequence, length, 0
        self.held: list[tuple[int, int, bytes, int]] = []

    def _emit(self, pieces):
        at = 0
        for doc_id, start, data, total in pieces:
            yield doc_id, start, len(data) // 4, zlib.crc32(data), total, self.sequence, at
            at += len(data) // 4
        self.sequence += 1

    def add(self, doc_id: int | None, data: bytes):
        total, pos = len(data) // 4, 0
        while pos < total:
            take = min(self.length - self.fill, total - pos)
            self.held.append((doc_id, pos, data[4 * pos : 4 * (pos + take)], total))
            self.fill += take
            pos += take
            if self.fill == self.length:
                yield from self._emit(self.held)
                self.held, self.fill = [], 0

    def close(self):
        """The rest, as sequences whose lengths are powers of two, the longest first."""
        left = self.fill
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                doc_id, start, data, total = self.held.pop(0)
                take = min(room, len(data) // 4)
                now.append((doc_id, start, data[: 4 * take], total))
                if 4 * take < len(data):
                    self.held.insert(0, (doc_id, start + take, data[4 * take :], total))
                room -= take
            yield from self._emit(now)
        self.fill = 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary is the path of a tokenizers file that every executor has. Each document's ids get `end` behind them,
    so null and empty texts are one id long; repeated rows are packed each; an empty table gives no piece; other
    columns are left out. sequence_id holds the task's number in its high bits and counts from 0 in the low 40.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        gc.set_threshold(200_000)  # the caches are large and hold no cycles
        hold("packing", _ids.cache_clear)
        ids, close = _ids(vocabulary), int(end).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, length)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            rows, texts = [], batch.column(1).cast(pa.large_string()).fill_null("")
            upto = np.cumsum(pc.binary_length(texts).to_numpy())
            k = 0
            while k < batch.num_rows:
                n = max(1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BYTES_AT_ONCE, "right")) - k)
                for doc_id, data in zip(batch.column(0).slice(k, n).to_pylist(), ids.of(texts.slice(k, n)), strict=True):
                    rows += packer.add(doc_id, data + close)
                k += n
            if rows:
                yield out(rows)
        if rows := list(packer.close()):
            yield out(rows)

    return along_curve(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
