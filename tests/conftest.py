import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from promolens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="promolens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from oracle_check import duck as make
    return make


@pytest.fixture()
def tmpdir_spark(spark):
    from promolens.session import scratch_path
    return lambda name: scratch_path(spark, name)
