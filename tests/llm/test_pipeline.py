"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import brute
import public_tokenizers
import pytest
from test_learned import library_ids, pieces_hold
from test_near import near_classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = texts_of(docs), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 4:
            break
        after = texts_of(docs)
        if name == "toxicity":
            assert len(after) > 0.7 * len(before) and all(before[i] == t for i, t in after.items())
        elif name == "line_dedup":
            want = {i: kept for i, _, _, kept in brute.dropped_lines(list(before.items()))}
            assert {i: t or "" for i, t in after.items()} == want
        elif name == "near_dedup":
            assert set(after) == set(near_classes([(i, t or "") for i, t in before.items()]).values())
        else:
            more = brute.pii_added([(i, t or "") for i, t in before.items()])
            for i, t in before.items():
                base = [s.split(":") for s in brute.pii_spans(t or "").split(",") if s]
                assert (after[i] or "") == brute.redacted(t or "", [(int(a), int(b), k) for k, a, b in base] + [(a, b, brute.KINDS[k]) for k, a, b in more[i]])
        before = after
    want, _ = library_ids("word_bpe_49k.json", [t or "" for t in before.values()])
    assert public_tokenizers.path("word_bpe_49k.json")
    pieces_hold(docs.collect(), {i: [[*ids, 1]] for i, ids in zip(before, want, strict=True)}, 2048)


def test_stages_on_edge_rows(spark, edge, edge_rows, empty):
    from pyspark.sql import functions as F

    docs = edge.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), "score", "row_key")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        assert sorted(map(str, ids)) == sorted(str(i) for i, _ in edge_rows) if name != "near_dedup" else {1, 3, 5, None} <= set(ids)
        assert stage(spark, docs.limit(0), SF).count() == 0
