"""The driver tables in the roles that linkage gives them.

Text: documents with doc_id % 3 = 0 are entities, 1 and 2 the records of sources 2 and 3; the part is lang.
Structured: part rows by p_partkey % 3 likewise; name p_name, house p_size, street p_brand, part p_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expressions import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(key: str):
    return F.when(F.col(key) % 3 == 0, "entity").otherwise("record")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, side, id, terms)"""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("part"), side("doc_id").alias("side"), F.col("doc_id").alias("id"), tokens(F.col("text")).alias("terms"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, id, src, name, house, street): src 1 for entities, 2 and 3 for records."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("part"),
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % 3 + 1).cast("int").alias("src"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("house"),
        F.col("p_brand").alias("street"),
    )


def part_pairs(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("part", "name")) -> DataFrame:
    """Entities and records of part with equal keys: l_ and r_ columns beside."""
    p = parts(spark, sf_dir)
    left, right = ({c: f"{x}_{c}" for c in p.columns if c not in keys} for x in "lr")
    return p.filter("src = 1").withColumnsRenamed(left).join(p.filter("src > 1").withColumnsRenamed(right), list(keys))


#: The structured tables' SQL forms, for oracles.
SQL_PARTS = """p AS (SELECT p_type AS part, p_partkey AS id, CAST(p_partkey % 3 + 1 AS INT) AS src, p_name AS name,
  CAST(p_size AS VARCHAR) AS house, p_brand AS street FROM part)"""

SQL_TEXT_TF = """t AS (
  SELECT lang AS part, CASE WHEN doc_id % 3 = 0 THEN 'entity' ELSE 'record' END AS side, doc_id AS id,
         unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}')) AS term FROM documents),
tf AS (SELECT part, side, id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT lang AS part, count(*) AS n FROM documents GROUP BY 1),
df AS (SELECT part, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT part, term, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df JOIN n USING (part) WHERE df <= 0.02 * n),
raw AS (SELECT part, side, id, term, (1 + ln(tf::DOUBLE)) * idf AS x FROM tf JOIN idf USING (part, term)),
norm AS (SELECT part, side, id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY ALL),
v AS (SELECT part, side, id, term, x / norm AS w, norm FROM raw JOIN norm USING (part, side, id))"""

SQL_TEXT_SCORES = (
    SQL_TEXT_TF
    + """,
s AS (SELECT a.part, a.id, b.id AS entity_id, round(sum(a.w * b.w), 6) AS score
  FROM v a JOIN v b ON a.part = b.part AND a.term = b.term AND a.side = 'record' AND b.side = 'entity' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY part, id ORDER BY score DESC, entity_id) - 1 AS rank FROM s WHERE score >= 0.05)"""
)
