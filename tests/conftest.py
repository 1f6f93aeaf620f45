import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from curaloom.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    return SF


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        if isinstance(v, float):
            return round(v, 5)
        return str(v)[:26] if hasattr(v, "isoformat") else v if isinstance(v, (int, str, bool)) else (v.item() if hasattr(v, "item") else str(v))

    def check(got, want):
        """The same rows by name of column, in any order."""
        assert sorted(got.columns) == sorted(want.columns)
        rows = [sorted((tuple(plain(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=str) for f in (got, want)]
        assert rows[0] == rows[1]

    return check
