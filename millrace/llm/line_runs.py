"""Line dedup: levelled sorted runs of line hashes, compacted as they grow; batches merge-anti-join them.

Batches come in falling order of doc_id. A batch's keys are merge-anti-joined with the runs: those that no run holds are new,
and their largest holder is in this batch; of the others only the number of documents goes into the batch's own run.

Built-in functions only. A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased;
keys of fewer than MIN_CHARS code points never count as repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import WORD_SPACE, materialise, shared_dir, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
FAN_IN = 3
BATCHES = 4

#: ASCII letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. lower() does it, and fast, unless the text has other letters that lower() changes."""
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(others, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(WORD_SPACE)))


def long_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, h1, h2, pos, first) of every line whose key has MIN_CHARS code points.

    h1 and h2 are two 64-bit hashes of the key; pos counts from 0; first is 1 on a key's first line in its row.
    row_key tells rows that share a doc_id apart, unless their texts are equal too.
    """
    text = text_or_empty()
    entries = F.filter(
        F.transform(
            _keys(text),
            lambda key, i: F.when(
                F.length(key) >= MIN_CHARS,
                F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), i.alias("pos")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    d = docs.select("doc_id", F.xxhash64(text).alias("row_key"), F.sort_array(entries).alias("_e"))
    before = F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,pos:int>")), F.col("_e"))
    marked = F.slice(
        F.zip_with(
            "_e",
            before,
            lambda x, y: F.struct(
                x.h1.alias("h1"),
                x.h2.alias("h2"),
                x.pos.alias("pos"),
                F.when((x.h1 == y.h1) & (x.h2 == y.h2), 0).otherwise(1).alias("first"),
            ),
        ),
        1,
        F.greatest(F.size("_e"), F.lit(0)),
    )
    return d.select("doc_id", "row_key", F.explode(marked).alias("x")).select("doc_id", "row_key", "x.*")


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, top_doc) in levels; FAN_IN runs of a level compact into one of the next.

    Runs are Parquet in the session's shared folder: a lost executor costs a re-read. `paths` is all the state
    there is, so a later session can take the runs up again.
    """

    def __init__(self, spark: SparkSession, levels: list[list[str]] | None = None, fan_in: int = FAN_IN, shared: DataFrame | None = None):
        """shared: the doc_ids that several rows have, if there are any."""
        self.spark, self.levels, self.fan_in, self.shared = spark, levels or [], fan_in, shared
        self.home = f"{shared_dir(spark)}/millrace/lines-{uuid.uuid4().hex}"

    SCHEMA = "h1 long, h2 long, n_docs long, top_doc long"

    @property
    def paths(self) -> list[list[str]]:
        return [list(level) for level in self.levels]

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.home}/L{level}-{uuid.uuid4().hex}"
        run.select("h1", "h2", "n_docs", "top_doc").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    @staticmethod
    def _merge(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        return self._merge(self._read([p for level in self.levels for p in level]))

    def _keys(self) -> DataFrame:
        return self._read([p for level in self.levels for p in level]).select("h1", "h2").hint("merge")

    def unseen(self, keyed: DataFrame) -> DataFrame:
        """The rows whose keys no run holds: a merge-anti-join with the runs."""
        return keyed.join(self._keys(), ["h1", "h2"], "left_anti")

    def add(self, lines: DataFrame) -> None:
        """Adds the batch's own run and compacts every level that is full.

        lines has h1, h2, first and doc_id; the doc_ids are others than those of earlier batches. A document counts once for a key,
        also where it has several rows; a null doc_id counts for none. Only keys that no run holds get their largest holder.
        """
        firsts = lines.filter("first = 1 AND doc_id IS NOT NULL").select("h1", "h2", "doc_id", F.lit(1).cast("long").alias("n"))
        again = firsts.join(self.shared, "doc_id", "left_semi") if self.shared is not None else firsts.limit(0)
        again = again.groupBy("h1", "h2", "doc_id").agg((1 - F.count("*")).alias("n")).filter("n < 0").select("h1", "h2", "doc_id", "n")
        own = lines.filter("doc_id IS NULL").select("h1", "h2", "doc_id", F.lit(0).cast("long").alias("n")).unionByName(firsts)
        own = own if self.shared is None else own.unionByName(again)
        own = materialise(own.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("top_doc")), "lines-batch")
        if any(self.levels):
            known = own.join(self._keys(), ["h1", "h2"], "left_semi").withColumn("top_doc", F.lit(None).cast("long"))
            own = self.unseen(own).unionByName(known)
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merge(self._read(full)), level + 1)
            level += 1


def drop_batch(runs: LineRuns, docs: DataFrame) -> DataFrame:
    """Incremental use: docs keep the lines whose keys earlier batches lack, then the batch adds its own run.

    Within the batch repeated lines stay; the columns of docs stay, with n_lines, n_dropped and the rest as text.
    """
    lines = materialise(long_lines(docs), "batch-lines")
    fresh = runs.unseen(lines)
    gone = lines.join(fresh.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti").select("doc_id", "row_key", "pos")
    gone = materialise(gone, "batch-gone")
    runs.add(lines)
    return _without(docs, gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the lines at the (doc_id, row_key, pos) of gone; n_lines and n_dropped beside."""
    places = gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    text = text_or_empty()
    d = docs.drop("n_lines", "n_dropped", "row_key", "_gone", "_lines", "_id", "_key")
    keep = d.columns
    d = d.withColumn("row_key", F.xxhash64(text))
    d = d.join(
        places.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")),
        "left",
    )
    d = d.withColumn("_lines", F.split(text, "\n"))
    n = F.size("_lines")
    none = F.array().cast("array<int>")
    gone_at = F.coalesce("_gone", none)
    pieces = F.zip_with(
        F.concat(F.array(F.lit(-1)), gone_at),
        F.concat(gone_at, F.array(n)),
        lambda a, b: F.slice(F.col("_lines"), a + 2, b - a - 1),
    )
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return d.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in keep],
        n.cast("long").alias("n_lines"),
        F.size(gone_at).cast("long").alias("n_dropped"),
    )


def drop_repeated(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs without the lines whose key is in min_docs documents or more, except in the largest doc_id that holds it.

    The lines' hashes are read once and enter the runs batch by batch, the largest doc_ids first; what the runs then hold as
    repeated takes its lines out of the texts. Null texts become one empty line; rows that share a doc_id are one document,
    and all of them keep a key's lines if that doc_id is the largest; null doc_ids count for nothing and keep no repeated
    line; an empty table stays empty; very long texts are read whole; columns pass through, but for n_lines, n_dropped,
    row_key, _gone, _lines, _id and _key.
    """
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)])).first()[0] or []
    after = sum((F.when(F.col("doc_id") > x, 0).otherwise(1) for x in bounds), F.lit(0))
    lines = materialise(long_lines(docs).withColumn("batch", after), "lines", "batch")
    shared = materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "lines-shared")
    runs = LineRuns(spark, shared=None if shared.isEmpty() else shared)
    for k in range(len(bounds) + 1):
        runs.add(lines.filter(F.col("batch") == k))
    repeated = materialise(runs.merged().filter(F.col("n_docs") >= min_docs), "repeated")
    gone = (
        lines.join(repeated, ["h1", "h2"])
        .filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top_doc")))
        .select("doc_id", "row_key", "pos")
    )
    return _without(docs, gone)
