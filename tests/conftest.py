import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from playlake.session import build_session

    s = build_session(master="local[8]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g",
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="playlake-wh-")})
    yield s
    s.stop()
