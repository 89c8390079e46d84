import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caudal.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__shuffle__partitions="4",
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted rows of a frame as plain tuples, columns in name order."""
    def take(df, *columns):
        df = df.select(*columns) if columns else df.select(*sorted(df.columns))
        return sorted((tuple(r) for r in df.collect()), key=repr)
    return take
