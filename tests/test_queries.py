"""Every query of the library against its SQL in DuckDB, on the small tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from strandline.plans import catalog

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(rows):
    return sorted([tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    rows = _plain(tuple(r[c] for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == _plain(duck.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
