import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from siftline.session import local_session

    session = local_session("*", 2, spark__sql__adaptive__enabled="true", spark__default__parallelism="2", spark__python__worker__reuse="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
