import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from litloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    session.prepare(s)
    session.checkpoint_folder(s)
    yield s
    s.stop()
