import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from archivemill.session import local_session  # noqa: E402

LINE_SCHEMA = "file string, block bigint, line bigint, value string"
FILE = "/data/2018/05/02/13/07.json.bz2"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Messages (dicts or raw text) -> lines of one file, in order."""

    def build(*messages, file=FILE, block=0):
        texts = [m if isinstance(m, str) else json.dumps(m) for m in messages]
        rows = [(file, block, i, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, LINE_SCHEMA)

    return build
