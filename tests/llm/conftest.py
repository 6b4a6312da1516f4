import pytest

from tickloom.session import ship_code

#: A table like documents, with a column of a clashing name.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int"


@pytest.fixture
def documents(spark):
    ship_code(spark)

    def make(texts, partitions=3, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en" if i else None), None if i == 1 else "s", len(t) if t else None, "r", i) for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return make


@pytest.fixture
def stored(documents, tmp_path):
    """The same as a plain scan of files."""

    def make(texts, **k):
        path = str(tmp_path / "t.parquet")
        df = documents(texts, **k)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)

    return make
