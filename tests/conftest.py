from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from forgelens.session import local_session

    s = local_session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
