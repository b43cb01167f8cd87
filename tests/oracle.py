"""Compares a query's rows with those of its SQL, names, types of columns and all."""

import numpy as np

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if v is None or isinstance(v, float) and v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def check(df, sql, duck):
    got = duck.execute(sql)
    names, types = [d[0] for d in got.description], {d[0]: str(d[1]) for d in got.description}
    want = got.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    for c, t in df.dtypes:
        assert TYPES.get(t, types[c]) == types[c], (c, t, types[c])
    at = [names.index(c) for c in cols]
    rows = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want)
    return len(rows)
