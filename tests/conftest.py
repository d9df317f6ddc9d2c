import sys
import tempfile
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from plumbline import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="plumbline-tests-")
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="4", spark__driver__memory="8g", spark__checkpoint__dir=folder,
        spark__ui__showConsoleProgress="false",
    )
    yield session
    session.stop()
