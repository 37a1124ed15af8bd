"""Order-insensitive comparison of a Spark result with SQL's."""

from decimal import Decimal

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return int(v) if isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
