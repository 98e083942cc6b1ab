import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pinmark.session import local_session, pickle_by_value, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    pickle_by_value()
    session = tune(local_session(8, 8, "pinmark-tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
