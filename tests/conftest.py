import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sitewatch.session import get_session
    s = get_session("local[4]", app="sitewatch-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from sitewatch.session import drop_scratch
    drop_scratch(s)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def one(df, col):
    rows = df.select(col).collect()
    assert len(rows) == 1
    return rows[0][0]
