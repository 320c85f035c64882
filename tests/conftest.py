import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from civicspark.session import build_session

    session = build_session("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(path).exists():
        pytest.skip("benchmark tables are not on this machine")
    return path
