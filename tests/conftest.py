import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parchmill.session import session

    made = session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__host="127.0.0.1", spark__driver__memory="2g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")), spark__default__parallelism="4",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def order(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=order)
