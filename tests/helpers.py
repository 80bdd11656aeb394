"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or str(value) in ("NaT", "<NA>") or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    if isinstance(value, int) or type(value).__name__.startswith(("int", "float", "Decimal")):
        return float(value)
    return str(value)


def rows(frame, columns):
    return sorted(str([plain(v) for v in r]) for r in frame[columns].values.tolist())


def same(spark_frame, duck_frame):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(duck_frame.columns)
    assert rows(spark_frame, columns) == rows(duck_frame, columns)
