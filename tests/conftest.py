"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxfield.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()
