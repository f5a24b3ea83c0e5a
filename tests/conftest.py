import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from lodestream.session import local_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
