import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from itinera.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
