import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from equitylake.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", app="equitylake-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # tests run without a cluster: give them a checkpoint root only when unset
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="equitylake-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="equitylake-test-")
