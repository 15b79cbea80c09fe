import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from parley.session import session
    from parley.shipping import ship

    s = session("tests", **{"spark__master": "local[4]", "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false"})
    ship(s)
    yield s
    s.stop()


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture
def same(spark):
    """Holds a query against its SQL in DuckDB."""
    import glob
    import os

    import duckdb

    def check(query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        df = query(spark, folder)
        cols = sorted(df.columns)
        mine = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert mine == sorted(tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall())

    return check
