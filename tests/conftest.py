import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import DATA  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")



@pytest.fixture(scope="session")
def spark():
    from tideline.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """DuckDB on the tables of sf0.01."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/sf0.01"):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/sf0.01/{f}')")
    return con
