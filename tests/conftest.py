import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from cardflow.session import local_session

    session = local_session("tests", cores=8, memory="8g", **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    yield session
    session.stop()


@pytest.fixture
def limit(spark):
    """Sets the size above which a key counts as hot."""
    from cardflow.session import MAX_GROUP_ROWS

    def set_limit(rows):
        spark.conf.set(MAX_GROUP_ROWS, str(rows))

    yield set_limit
    spark.conf.unset(MAX_GROUP_ROWS)
