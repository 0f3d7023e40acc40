import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoint")
    session = build_session("logweave-tests", shuffle_partitions=4, checkpoint_dir=str(folder))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF_SMALL = "/root/testdata/sf0.001"
