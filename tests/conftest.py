import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from terrafold.session import local

    return local(4, "4g")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Whether a query and its SQL give the same rows at the smallest size."""

    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        return None if v is None or v != v else v

    def check(query, sql):
        got = query(spark, SF)
        names = sorted(got.columns)
        want = duck.sql(sql)
        assert sorted(want.columns) == names
        rows = lambda data, cols: sorted(repr(tuple(plain(dict(zip(cols, r))[c]) for c in names)) for r in data)
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)

    return check
