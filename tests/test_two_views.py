"""The search by two views against SQL, on odd rows and in many small cells, and that it writes no row for a pair of texts."""

import random

import pytest
from test_copies import compared, joined

from millrace.operators import two_views as T

QUERIES = ["combined_view_topk", "reverse_rank", "channel_union"]
COLUMNS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def written(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/made")
    made = next(f for f in (folder / "made").iterdir() if f.suffix == ".parquet")
    made.rename(folder / "part.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column but the key, negative ids, names that differ by a space, empty names, copies."""
    r = random.Random(7)
    names = ["red ring", "redring", "red rod", "big blue bolt", "x", "", "old ring sons", None]
    some = lambda i: r.choice([*names, f"green plate {i % 40}"])
    rows = [(i, some(i), None if i % 37 == 0 else f"Brand#{i % 5}", None if i % 41 == 0 else "ABC"[i % 3 if i % 2 else 0], None if i % 43 == 0 else i % 6) for i in range(-30, 500)]
    return written(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.mark.parametrize("name", QUERIES)
def test_small_cells_equal_sql(spark, odd, monkeypatch, name):
    for bound, value in (("CELL_RECORDS", 7), ("BUCKET_PAIRS", 50), ("SCORES", 200), ("PACKED", 40), ("BATCH", 30)):
        monkeypatch.setattr(T, bound, value)
    compared(spark, odd, name)


@pytest.mark.parametrize("name", QUERIES)
def test_texts_that_mix_freely_are_not_paired(spark, tmp_path, name):
    r = random.Random(3)
    words = [["red", "blue", "cold", "old", "hot"], ["ring", "rod", "bolt", "plate"]]
    rows = [(i, " ".join(map(r.choice, words)), f"Brand#{r.randrange(6)}", "SMALL", r.randrange(10)) for i in range(2400)]
    d = compared(spark, written(spark, tmp_path, rows), name)
    assert 0 < max(joined(d._jdf.queryExecution().executedPlan())) < 12 * len(rows)
