import pytest

pytest.importorskip("millrace.llm")

PROSE = "the quick fox and a lazy dog went to town with seven old friends who told of storms and ships and distant hills "


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, equal texts, a shared doc_id, a missing one, very long texts, odd characters."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, ""),
        (2, None),
        (3, PROSE * 3),
        (3, PROSE * 3),
        (4, PROSE * 3),
        (5, long),
        (6, " \t\n "),
        (7, "x" * 200_000),
        (8, "日本語 テキスト é ñ 🙂 \x1c \x85 don't <|endoftext|> IT'S"),
        (9, "one"),
        (9, "two words"),
        (None, "a row without an id"),
        (10, "!!! ??? ---"),
        (11, "line\n" * 2000),
    ]


#: Columns whose names operators use for their own.
CLASHING = "score n class_id row_key host kept _gone _k _id text_ n_lines n_words sig bands curve pos band predicted".split()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    rows = [(i, t, *["x"] * len(CLASHING)) for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
