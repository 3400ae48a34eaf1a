import os
import sys

import pytest

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # its threads can stall beside a JVM
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chiasma.session import get_session

    s = get_session("tests", "local[4]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
