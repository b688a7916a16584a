import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetaudit.session import local_session

    s = local_session(4, app="fleetaudit-tests")
    yield s


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
