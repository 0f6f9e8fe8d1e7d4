"""Rows of a Spark frame and of DuckDB SQL in one comparable form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def rows(values, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(v[i]) for i in at]) for v in values)


def spark_rows(df):
    return sorted(df.columns), rows([tuple(r) for r in df.collect()], df.columns)


def duck_rows(sql, sf_dir):
    c = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(got.fetchall(), names)
