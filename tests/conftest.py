from __future__ import annotations

import pytest

import chronoband.plans  # noqa: F401
from chronoband.session import ROWS_PER_CHUNK, ROWS_PER_CHUNK_CONF, session
from tests.compare import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    return oracle(SMALL)


@pytest.fixture()
def chunked(spark):
    """Force the plans for large groups."""
    def use(rows: int):
        spark.conf.set(ROWS_PER_CHUNK_CONF, str(rows))
    yield use
    spark.conf.set(ROWS_PER_CHUNK_CONF, str(ROWS_PER_CHUNK))
