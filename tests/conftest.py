import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changelake.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = build(
        "tests", "local[8]", 8, spark__checkpoint__dir=scratch, spark__driver__memory="8g", spark__sql__warehouse__dir=scratch
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
