"""Queries that SQL can express give its rows."""

from pathlib import Path

import duckdb
import pytest

from quern.llm import entry


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_rows_equal_the_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall(), key=str)
    got = sorted((tuple(r) for r in entry.queries()[name](spark, sf_dir).select(*columns).collect()), key=str)
    assert got == expected and got


def test_all_queries_are_there():
    assert sorted(entry.queries(), key=lambda n: int(n[2:].split("_")[0])) == ["op1_fingerprints", "op2_html_text", "op3_simhash", "op4_packing", "op5_toxicity", "op6_line_dedup", "op7_url_rules", "op8_decontaminate", "op9_chat_format", "op10_token_counts"]
