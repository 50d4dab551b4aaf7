"""Rows of a DataFrame against rows of a SQL result, in any order, columns by name."""

import math
from collections import Counter


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_cell(r[k]) for k in order) for r in data)


def same(df, con, sql):
    got = df.collect()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
