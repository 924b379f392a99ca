from __future__ import annotations

import pytest

from codecorpus.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "codecorpus-tests")
    yield session
    session.stop()


@pytest.fixture
def units(spark):
    """A table of units from (unit_id, code) pairs or plain texts."""
    def make(*rows):
        data = []
        for i, r in enumerate(rows):
            uid, code = r if isinstance(r, tuple) else (f"u{i}", r)
            data.append((uid, f"src/{uid}.js", "file", code))
        return spark.createDataFrame(data, "unit_id string, path string, kind string, code string")
    return make
