"""Linkage sources and sinks: tab-separated tables without quoting, truth lists, output lists and their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = ("entity_id", "business_name", "business_address", "country")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RAW) -> DataFrame:
    """All columns as text, quotes as they stand, missing values as empty text. The header must name the columns."""
    head = spark.read.option("sep", "\t").option("quote", "").option("header", "true").csv(path).columns
    if tuple(head) != tuple(columns):
        raise ValueError(f"{path}: columns {head}, expected {list(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"sep": "\t", "quote": "", "header": "true", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return spark.read.options(**options).schema(schema).csv(path).na.fill("")


def load_source(spark: SparkSession, path: str, source: int, expected_rows: int | None = None) -> DataFrame:
    """(src, entity_id, name, addr, country) of a source, after its contract: ids begin with S<source>- and are unique."""
    d = read_tsv(spark, path)
    facts = d.agg(
        F.count("*").alias("n"),
        F.countDistinct("entity_id").alias("ids"),
        F.count_if(~F.col("entity_id").startswith(f"S{source}-")).alias("foreign"),
    ).first()
    problems = [
        text
        for text, bad in (
            (f"{facts['n']} rows, expected {expected_rows}", expected_rows is not None and facts["n"] != expected_rows),
            ("ids repeat", facts["ids"] != facts["n"]),
            (f"{facts['foreign']} ids of another source", facts["foreign"]),
        )
        if bad
    ]
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    return d.select(
        F.lit(source).alias("src"), "entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country"
    )


def load_sources(parts: list[DataFrame]) -> DataFrame:
    """Raw and synthetic sources as one table, an origin column telling them apart."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_lists(spark: SparkSession, path: str, key: str = "source1_entity_id", column: str = "matched_entity_ids") -> DataFrame:
    """(key, ids: array) of a list file."""
    d = read_tsv(spark, path, (key, column))
    return d.select(key, F.filter(F.split(column, ","), lambda x: x != "").alias("ids"))


def load_truth(lists: DataFrame, entities: DataFrame, records: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """Truth pairs (s1, src, rid) of known ids: lists exploded, both ids looked up. entities (entity_id), records (src, entity_id)."""
    pairs = lists.select(F.col(key).alias("s1"), F.explode("ids").alias("rid"))
    known = pairs.join(entities.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    return known.join(records.select("src", F.col("entity_id").alias("rid")), "rid").select("s1", "src", "rid")


def id_lists(entities: DataFrame, pairs: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """One row for each entity: its distinct ids, sorted and comma-joined; empty text if it has none."""
    lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out))
    return entities.join(lists, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_lists(lists: DataFrame, path: str, order: str) -> None:
    """One tab-separated file with a header, rows in order; Spark's committer makes the write all or nothing."""
    options = {"sep": "\t", "header": "true", "quote": "", "emptyValue": ""}
    lists.orderBy(order).coalesce(1).write.options(**options).mode("overwrite").csv(path)


def contract_violations(entities: DataFrame, lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """(problem, n): how many rows break each rule. entities (id); lists and candidates (id, ids: array)."""
    per = lists.join(candidates.select("id", F.col("ids").alias("allowed")), "id", "left")
    outside = F.size(F.array_except("ids", F.coalesce("allowed", F.array().cast(lists.schema["ids"].dataType)))) > 0
    repeated = F.size(F.array_distinct("ids")) < F.size("ids")
    flags = per.agg(F.count_if(repeated).alias("r"), F.count_if(outside).alias("o"))
    counted = [
        entities.join(lists, "id", "left_anti").select(F.count("*").alias("n")).select(F.lit("missing entity").alias("problem"), "n"),
        lists.join(entities, "id", "left_anti").select(F.count("*").alias("n")).select(F.lit("unknown entity").alias("problem"), "n"),
        flags.select(F.lit("repeated id").alias("problem"), F.col("r").alias("n")),
        flags.select(F.lit("not a candidate").alias("problem"), F.col("o").alias("n")),
    ]
    whole = counted[0]
    for d in counted[1:]:
        whole = whole.unionByName(d)
    return whole
