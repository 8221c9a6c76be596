"""Compare a Spark query with its DuckDB SQL on the same Parquet."""

import glob
import math
import os

import duckdb


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in data), key=repr)


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = con.execute(sql)
    return {c[0]: str(c[1]) for c in got.description}, got.fetchall()


#: DuckDB's type for each of Spark's.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    kinds, data = from_duckdb(sql, sf_dir)
    columns = list(kinds)
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds, (df.dtypes, kinds)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, data)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (a, b)
    return len(ours)
