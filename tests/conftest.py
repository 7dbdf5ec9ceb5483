import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from epochlens.session import build_session

    s = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false", "spark.executorEnv.PYTHONPATH": str(Path(__file__).parent)},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
