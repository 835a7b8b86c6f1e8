import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import local_session

    s = local_session(4, shuffle_partitions=4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('scratch')}")
    yield s
    s.stop()
