import pytest

from corpora import corner_rows, make


@pytest.fixture(scope="session")
def corners(spark):
    return make(spark, corner_rows())
