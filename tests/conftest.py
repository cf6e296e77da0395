import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from proofloom.session import get_spark

    s = get_spark("local[*]", **{"spark.sql.shuffle.partitions": "8"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="proofloom-test-"))
    # the pretend model and checker of the tests, for the workers
    s.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "stubs.py"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="proofloom-t-")
