import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    """One session for all tests, the text operators' among them."""
    from barloom.session import build_session, clear_scratch
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"     # for the Python workers
    s = build_session("tests", "local[8]", 4, "8g")
    yield s
    clear_scratch(s)
    s.stop()
