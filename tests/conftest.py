from __future__ import annotations

import pytest

from fleetsift.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "fleetsift-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
