import pytest

from tests.llm.helpers import frame


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def clashing(spark):
    return frame(spark, extra=True).cache()
