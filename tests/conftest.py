import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("CLAUSEMILL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from clausemill.session import build_session

    session = build_session("tests", master="local[4]", partitions=4)
    yield session
    session.stop()
