import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, n long, score double, bands string, digest binary"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, repeated rows and clashing column names."""
    base = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 977}" for i in range(30_000))
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "one two"), (6, long), (7, long + " end"), (None, base), (None, None), (8, "!!! ???"), (9, "naïve café 日本 \U0001f600  x\n"), (10, base.replace("w7 ", "z7 "))]
    full = [(i, t, None, None if i == 3 else "s", None if t is None else len(t), "k", 1, None, 0.5, None, None) for i, t in rows]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
