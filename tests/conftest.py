import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import session

    s = session("local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__driver__memory="4g", spark__log__level="ERROR", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()
