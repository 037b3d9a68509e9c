"""What the operators of this folder share: tables, shared storage, word codes."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as code points 0x20 and 0x09-0x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Frequent function words of the corpus languages.
COMMON_WORDS = {
    "en": "the of and to in is was that it for on with as be by at are this from or an have not they which you were his her had but",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "le la les de des du et un une en dans que qui pour par sur est pas au plus ce il elle sont avec se ne ou son sa aux",
    "es": "el la los las de del y en un una que por con para se no es su al lo como más pero sus le o este ha me si sin",
}


def common_words() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local session that names none gets a temporary one:
    on a cluster each machine would write to a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialise(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{what}-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What is stripped from both ends of a word.
EDGE = string.punctuation + "¿¡«»„“”‘’‚‹›…–—·•"


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """Says that this process keeps caches for `name`; those that other operators left in it are released."""
    for other in [x for x in _HELD if x != name]:
        _HELD.pop(other)()
    _HELD[name] = release


#: Bytes of texts whose chunks are told apart at once.
BYTES_AT_ONCE = 8_000_000


class WordCodes(dict):
    """White-space chunk -> 64-bit code of its lower-cased word without edge punctuation; 0 if none is left.

    The cache is emptied at `limit` entries, so its memory has a bound that doesn't depend on the data.
    """

    def __init__(self, limit: int = 300_000, special: dict[str, int] | None = None):
        super().__init__()
        self.limit = limit
        self.special = special or {}

    def __missing__(self, chunk: str) -> int:
        import xxhash

        word = chunk.lower().strip(EDGE)
        if not word:
            code = 0
        else:
            code = self.special.get(word)
            if code is None:
                code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | (1 << 63)
        if len(chunk) <= 64:
            self[chunk] = code
        return code

    def codes(self, text: str) -> np.ndarray:
        chunks = text.split()
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, chunks), np.uint64, len(chunks))

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """codes() of each text, with a 0 more for white space at an end and for no text. Chunks are told apart in Arrow, at most BYTES_AT_ONCE of texts (one at least) at once, and
        only different ones become Python's."""
        texts = texts.cast(pa.large_string())
        upto = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BYTES_AT_ONCE, "right")))
            split = pc.utf8_split_whitespace(texts.slice(first, last - first))  # the white space that split() takes
            coded = split.flatten().dictionary_encode()
            different = coded.dictionary.to_pylist()
            if len(self) > self.limit:
                self.clear()
            codes = np.fromiter(map(self.__getitem__, different), np.uint64, len(different))[coded.indices.to_numpy()]
            at = split.offsets.to_numpy() - split.offsets[0].as_py()
            yield from (codes[i:j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False))
            first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that scatters their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd factors that tell a shingle's places apart.
_PLACES = mix64(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingle_codes(codes: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit codes of the runs of `width` words; a text of fewer words is one shingle, no words none."""
    n = len(codes)
    if n == 0:
        return codes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out += codes[k : n - width + 1 + k] * _PLACES[k % len(_PLACES)]
        if k % len(_PLACES) == len(_PLACES) - 1:
            out = mix64(out)
    return mix64(out)
