import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = os.environ.get("CHORUS_CHECK_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from chorus.session import get_spark
    s = get_spark("chorus-tests", cpus="*", shuffle_partitions=8)
    yield s
    s.stop()
