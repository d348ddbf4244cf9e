"""A query and its DuckDB equivalent, run side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.is_dir(), reason="the test tables aren't there")


def _plain(row):
    return tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in row)


def same_rows(spark, query, sql):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = query(spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((_plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    answer = con.execute(sql)
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = sorted((_plain([r[names.index(c)] for c in columns]) for r in answer.fetchall()), key=repr)
    assert got == want
