from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SF = "/root/testdata/sf0.001"

#: ids and texts: copies, nulls, empty and blank texts, a very long word, ties, repeated rows, and rows that share an id.
ROWS = [
    (1, "Hello World, this is a text"),
    (2, "hello world, THIS is a text"),
    (3, None),
    (4, ""),
    (None, "HELLO world, this is a text"),
    (5, "x1" * 60_000 + " end"),
    (6, "twice the same row"),
    (6, "twice the same row"),
    (6, "another text of one id"),
    (7, "É É à la carte"),
    (8, "é é à la carte"),
    (9, " \t\n \r\n"),
    (10, "a\x00b <|endoftext|>  two  blanks \u00a0 ▁ 你好 😀\n\n"),
]


@pytest.fixture(scope="session", autouse=True)
def importable_workers(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows with columns whose names the operators use themselves, and nulls in them."""
    names = "kept keep_id _row _key _salt _norm unit place pass cell n_words host listed h1 start length ids fp component".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *[None] * len(names)) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """``doc_id, text`` of the smallest table, as Python values in the order of ids."""
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
