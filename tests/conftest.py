import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelcohort.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


def checks(df):
    """Sorted (check, key) pairs of a violation frame."""
    return sorted((r["check"], r["key"]) for r in df.collect())
