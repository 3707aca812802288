"""Comparison of a Spark result with DuckDB's: names, values, and kinds of types."""

import datetime

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return x.isoformat() if isinstance(x, datetime.datetime) else repr(x)


def same(df, relation):
    names = sorted(relation.columns)
    assert names == sorted(df.columns)
    types = {n: KINDS[str(t)] for n, t in zip(relation.columns, relation.types, strict=True)}
    assert types == dict(df.dtypes)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(map(plain, r)) for r in relation.select(*names).fetchall())
    assert ours == theirs
