import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes rows as tables of a folder and returns the folder."""

    def make(**rows):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
        return folder

    return make
