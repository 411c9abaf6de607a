import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from keystrata.session import local_session

    session = local_session(2, 2, "tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()
