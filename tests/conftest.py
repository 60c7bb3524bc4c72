import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tableguard.session import get_spark

    s = get_spark(master="local[8]", shuffle_partitions=8)
    yield s


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)
