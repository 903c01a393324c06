import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from netledger.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
