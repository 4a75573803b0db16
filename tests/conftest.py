import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from callwise.session import get_spark
    s = get_spark("local[8]", shuffle_partitions=8, app_name="callwise-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smoke_dir():
    return SMOKE
