import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gradewise.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8, app="gradewise-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from gradewise.session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return con
