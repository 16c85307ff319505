import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ontide.session import build_session

    session = build_session(
        "ontide-tests",
        spark__master="local[8]",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions="4",
        # a plan's text keeps long paths whole
        spark__sql__maxMetadataStringLength="1000",
        spark__default__parallelism="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, small):
    from ontide.sources.adapter import delivery_tables

    return delivery_tables(spark, small)


@pytest.fixture(scope="session")
def mart(spark, tables):
    from ontide.operators.mart import order_mart
    from ontide.session import stage

    return stage(order_mart(tables))
