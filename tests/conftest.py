import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lemmaforge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", 4, "4g")
    yield session
    session.stop()


def rows(df, *order):
    names = order or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
