import pytest


@pytest.fixture
def table(spark):
    """Rows (id, text) as a DataFrame with extra columns whose names clash with those used inside."""

    def make(rows, id_col="doc_id", text_col="text", partitions=3):
        extra = "id long, digest string, n long, block string, word string, label double"
        full = [(i, t, 7, "x", 1, "y", "z", 0.5) for i, t in rows]
        return spark.createDataFrame(full, f"{id_col} long, {text_col} string, {extra}").repartition(partitions)

    return make
