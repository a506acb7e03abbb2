import pytest
from samples import ODD, prose


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, f"s{k}", -k) for k, t in enumerate(ODD)] + [(3, "one", "again", 0), (3, "one", "again", 0), (None, prose(3, 30), None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_shingles long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, lang string")
