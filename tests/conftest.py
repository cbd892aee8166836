from __future__ import annotations

import os

import pytest

from loomrow.session import get_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture
def rows():
    def collect(df, *order):
        df = df.orderBy(*order) if order else df
        return [row.asDict(recursive=True) for row in df.collect()]

    return collect
