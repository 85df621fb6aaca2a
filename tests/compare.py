"""Results of Spark and DuckDB as sorted, rounded rows."""

import datetime
import decimal


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs
