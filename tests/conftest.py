import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from listwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "listwright-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def landing(spark):
    """Builds landed responses from (source, feed_key, body) rows."""
    from listwright.schemas import LANDING

    def build(*rows, status=200, cycle=1):
        import datetime

        at = datetime.datetime(2024, 1, 31, 12, 0)
        return spark.createDataFrame(
            [
                (cycle, source, key, "http://feed.test/", status, "application/json", at, body)
                for source, key, body in rows
            ],
            LANDING,
        )

    return build
