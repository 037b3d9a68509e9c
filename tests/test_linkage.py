"""A whole linkage on a small table, stage by stage on disk."""

from pyspark.sql import functions as F

from millrace.plans import linkage
from millrace.plans.roles import parts

SF = "/root/testdata/sf0.001"


def test_linkage_end_to_end(spark, tmp_path):
    p = parts(spark, SF)
    street = F.lower(F.replace("street", F.lit("#"), F.lit(" ")))
    raw = p.select("part", "id", "src", "name", F.concat("house", F.lit(" "), street, F.lit(" st")).alias("addr"), "street")
    e = raw.filter("src = 1").select(F.col("id").alias("s1"), "name", "addr", F.col("part").alias("country"))
    r = raw.filter("src > 1").select(F.col("id").alias("rid"), "src", "name", "addr", F.col("part").alias("country"))
    a = raw.filter("src = 1").select("part", "name", F.col("id").alias("s1"))
    truth = a.join(raw.filter("src > 1").select("part", "name", "src", F.col("id").alias("rid")), ["part", "name"]).select("s1", "src", "rid")
    settings = linkage.Settings(k_name=5, k_addr=5, k_comb=5, k_reverse=3, k_wide=8, k_empty=5, max_df_name=0.5, max_df_addr=0.5)
    stages = linkage.Stages(spark, str(tmp_path))
    kept = linkage.link(e, r, truth, stages, settings).collect()
    owners = {(x["src"], x["rid"]) for x in kept}
    assert kept and len(owners) == len(kept)
    true = {tuple(x) for x in truth.collect()}
    assert sum((x["s1"], x["src"], x["rid"]) in true for x in kept) > 0.6 * len(kept)
    assert set(stages.report) == {"norm_entities", "norm_records", "splits", "candidates", "pruned", "scored", "kept"}
