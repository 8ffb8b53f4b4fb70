import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lithic.session import build_session

    session = build_session("tests", 4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
