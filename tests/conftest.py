import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyframe.session import build_session, shared_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    shared_dir(s)  # set a private checkpoint folder only when the session has none
    yield s
    s.stop()
