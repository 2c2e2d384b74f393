"""What tests share."""

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def same_rows(df, relation):
    """Compares a DataFrame with a DuckDB relation, by column name and in any order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert got == want
    return len(got)
