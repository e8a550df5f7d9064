import pytest

from feedloom.llm.common import ship_package

DOCS = "doc_id bigint, text string, score string, fp string, h1 int, token string, shard int"


@pytest.fixture(scope="session")
def llm_spark(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(llm_spark):
    """Documents of (doc_id, text), with more columns whose names the operators use inside."""

    def make(rows):
        filled = [(i, t, "x", "y", 1, "z", 2) for i, t in rows]
        return llm_spark.createDataFrame(filled, DOCS)

    return make
