"""Compare registered queries with their SQL on one folder of tables."""

from tests.conftest import oracle_rows, settled


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, got = settled(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = settled(*oracle_rows(sf_dir, sql))
    assert names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
    return len(got)
