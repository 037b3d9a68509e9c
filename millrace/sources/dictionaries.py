"""Mined dictionaries as JSON lines, tables by part, and tables of drifting columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dictionary(entries: DataFrame, path: str, key: str, value: str) -> None:
    """A (key, value) table as JSON lines, sorted within its files."""
    entries.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).sortWithinPartitions("key").write.mode("overwrite").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_dictionary(spark: SparkSession, path: str, most: int = 1_000_000) -> dict[str, str]:
    """The dictionary at path, of at most `most` entries; none where nothing was mined. Of a repeated key the least value counts."""
    if not _there(spark, path):
        return {}
    rows = spark.read.schema("key string, value string").json(path).filter("key IS NOT NULL").groupBy("key").agg(F.min("value").alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} holds more than {most} entries")
    return {r["key"]: r["value"] for r in rows}


def write_by_part(df: DataFrame, path: str, part: str) -> None:
    """One folder a part, so a filter on the part reads its folder alone. Rows of a part are spread over several writers."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def drifted_union(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables that have grown columns over time; a column that a table lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
