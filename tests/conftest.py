import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from bizlens.session import get_spark
    s = get_spark(app="bizlens-tests", master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as a list of tuples (optionally a column subset), sorted for stable asserts."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
