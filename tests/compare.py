"""Rows of a query and of its SQL in one canonical form."""

import math


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__}:{v}"


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())
