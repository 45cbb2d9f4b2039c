"""A session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strataweave.session import get_session, ship

    s = get_session("local[4]", 4, spark__driver__memory="3g")
    ship(s)
    yield s
    s.stop()
