import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from estatelens.session import local_session

    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine here; a cluster brings its own
    session = local_session(8, partitions=4, memory="8g", **{"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared + "/warehouse"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
