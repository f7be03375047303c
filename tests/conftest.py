import pytest

from sessionloom.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s
