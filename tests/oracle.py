"""Compare a registered query with its SQL twin, by value and regardless of row order."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in records)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(frame, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(result.fetchall(), names)
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(frame.columns) == sorted(names)
    found_types = {n: KINDS.get(k, k) for n, k in frame.dtypes}
    actual = rows([tuple(r) for r in frame.collect()], frame.columns)
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra of {sum(expected.values())}:"
        f" {list(missing)[:3]} / {list(extra)[:3]}"
    )
    wrong = {n: (found_types[n], types[n]) for n in names if found_types[n] != types[n]}
    assert not wrong, f"types differ: {wrong}"
    return sum(actual.values())
