"""The blocked text search against SQL, on odd rows and in many cells, and that it writes no row for a pair."""

import duckdb
import pytest
from test_copies import joined
from test_queries import plain

from millrace.operators import search as S
from millrace.plans import registry

#: Repeated, null and negative ids, null and empty texts, a null language, copies, a text of one word.
ROWS = [
    (i if i % 17 else None, None if i % 19 == 0 else " ".join(f"word{(i * k + k * k) % 211}" for k in range(i % 9)) + f" pair{i // 2}" * (i % 3), None if i % 23 == 0 else "en" if i % 4 else "de")
    for i in range(-20, 600)
] + [(3, "word1 word7 word100", "en"), (4, "word1 word7 word100", "en"), (4, "word1 pair9 pair9", "en"), (700, "x", "fr")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


def rows(d, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in d.collect()), key=repr)


@pytest.mark.parametrize("cells", [64_000, 7])
@pytest.mark.parametrize("name", ["tfidf_topk_lang", "recall_at_k"])
def test_search_equals_sql_without_rows_for_pairs(spark, folder, monkeypatch, name, cells):
    monkeypatch.setattr(S, "CELL_ENTITIES", cells)
    monkeypatch.setattr(S, "SUMS", cells)
    monkeypatch.setattr(S, "PRODUCTS", cells)
    d = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    order, columns = [c[0] for c in cursor.description], sorted(d.columns)
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows(d, columns) == want and want
    assert max([0, *joined(d._jdf.queryExecution().executedPlan())]) <= 10 * len(ROWS)


def test_packed_terms_come_back(spark):
    import numpy as np

    sizes = np.array([0, 3, 1, 0, 2])
    codes, counts = np.array([0, 5, 2**31 - 1, 7, 127, 128]), np.array([1, 200, 2**31, 1, 16384, 3])
    back = S._unpacked(S._packed(np.repeat(np.arange(5), sizes), codes, counts, 5).slice(1))
    assert [x.tolist() for x in back] == [codes.tolist(), counts.tolist(), sizes[1:].tolist()]
