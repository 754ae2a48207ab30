import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    from docspark.session import session

    s = session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__sql__warehouse__dir=f"file://{tmp_path_factory.mktemp('warehouse')}",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
