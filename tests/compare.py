"""Run a registered query and its SQL on the same tables and compare all values."""

import math
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if isinstance(value, (date, datetime)):
        return str(value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return sorted(names), rows


def difference(df, sql, sf_dir):
    """Empty if equal, else what differs."""
    names, left = spark_rows(df)
    duck_names, right = duck_rows(sql, sf_dir)
    if names != duck_names:
        return f"columns {names} and {duck_names}"
    if left != right:
        return f"only Spark {list((left - right).items())[:3]}, only SQL {list((right - left).items())[:3]}"
    return ""
