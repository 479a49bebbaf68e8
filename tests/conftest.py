import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from cellgraph.session import build_session

    s = build_session("local[8]", "cellgraph-tests", shuffle_partitions=8, driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
