import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from engramma.session import local_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_spark(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    ship(s)
    yield s


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
