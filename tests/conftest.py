import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from spindrift.session import build_session

    conf = {"spark.sql.shuffle.partitions": "3", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a frame as a sorted list of plain tuples in the order of its columns."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in r])

    return collect
