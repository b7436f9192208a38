from __future__ import annotations

import pytest

from quillmark.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()
