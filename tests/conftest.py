import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from recallgrid.session import build_session

    s = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
