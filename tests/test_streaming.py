"""Streams give what the batch form gives."""

from pyspark.sql import functions as F

from millrace.streaming import events as S

SF = "/root/testdata/sf0.001"


def run(stream, mode, name, spark, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_equal_batch(spark, tmp_path):
    source = tmp_path / "in"
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(source))
    got = run(S.tumbling(S.read_events(spark, str(source), 100)), "complete", "windows", spark, tmp_path)
    assert got.exceptAll(S.tumbling(batch)).count() == 0 and got.count() == S.tumbling(batch).count()


def test_best_matches_keep_the_latest_best(spark, tmp_path):
    source = tmp_path / "scored"
    rows = [(i % 7, i % 5, (i * 37 % 100) / 100) for i in range(100)]
    spark.createDataFrame(rows, "rid long, s1 long, p double").repartition(4).write.parquet(str(source))
    stream = spark.readStream.schema("rid long, s1 long, p double").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = run(S.best_matches(stream), "update", "best", spark, tmp_path)
    last = {r["rid"]: (r["s1"], r["p"]) for r in got.groupBy("rid").agg(F.max_by("s1", F.struct("p", -F.col("s1"))).alias("s1"), F.max("p").alias("p")).collect()}
    want = {}
    for rid, s1, p in rows:
        if rid not in want or (p, -s1) > (want[rid][1], -want[rid][0]):
            want[rid] = (s1, p)
    assert last == want
