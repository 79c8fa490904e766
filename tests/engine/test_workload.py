"""Every registered query gives the rows of its SQL."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quern.plans import workload


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted(([clean(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", workload.WORKLOAD)
def test_rows_equal_the_oracles(spark, sf_dir, oracle, name):
    df = workload.run(spark, sf_dir, name)
    cursor = oracle.execute(workload.WORKLOAD[name].sql)
    expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected
