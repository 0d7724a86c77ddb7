import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.runtime import build_session

    s = build_session(4, "4g", spark__checkpoint__dir=tmp_path_factory.mktemp("checkpoint").as_uri())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
