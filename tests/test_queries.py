"""Every query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from lastleg import queries as Q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(frame, columns):
    def value(x):
        if isinstance(x, str) or not hasattr(x, "__len__"):
            return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        return str(list(x))

    return sorted(tuple(value(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, FOLDER).toPandas(), duck.execute(Q.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_rows_only(spark, name):
    assert Q.queries()[name](spark, FOLDER).count() > 0
