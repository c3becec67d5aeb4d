import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from tidemark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tidemark-tests-")
    session = local_session(
        "tests",
        4,
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def same(a, b) -> bool:
    """Equal as bags of rows."""
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)
