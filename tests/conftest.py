import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trafficlens.session import checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="tl-test-")


def opened(df):
    """Paths of the files that a scan without a shuffle opens, after partition pruning."""
    out = []
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        rdd = leaves.apply(i).inputRDDs().head()
        if not hasattr(rdd, "filePartitions"):
            continue
        parts = rdd.filePartitions()
        for j in range(parts.size()):
            out += [f.urlEncodedPath() for f in parts.apply(j).files()]
    return out
