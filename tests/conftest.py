import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import local_session

    return local_session(4, "4g", spark__sql__shuffle__partitions="4")


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""

    def get(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return get
