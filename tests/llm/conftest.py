import pytest

CHUNK = "id string, repo_id string, file_path string, language string, start_line int, end_line int, content string, key string, n bigint"


@pytest.fixture
def chunks(spark):
    def make(rows):
        """Rows of (id, path, content), with columns whose names clash with the operators' own."""
        return spark.createDataFrame([(i, None, p, None, 1, None, c, "k", 0) for i, p, c in rows], CHUNK)

    return make


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, key string, size int")

    return make
