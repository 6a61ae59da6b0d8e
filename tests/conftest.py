import sys
from numbers import Number
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from trellis.session import local_session

    session = local_session("*", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df):
    """Rows of a pandas table as comparable tuples, columns by name."""
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else str(x).removesuffix(" 00:00:00") if not isinstance(x, Number) else float(x) + 0.0 for x in r))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))
