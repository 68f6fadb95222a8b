"""Every query of the base library against its SQL, over whole tables."""

import duckdb
import pytest

from burnish.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same_rows(df, sql):
    rows = views().execute(sql)
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    order = sorted(range(len(names)), key=lambda i: names[i])
    wanted = [tuple(plain(r[i]) for i in order) for r in rows.fetchall()]
    got = [tuple(plain(r[names[i]]) for i in order) for r in df.collect()]
    assert got and sorted(got, key=repr) == sorted(wanted, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    same_rows(df, SQL[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
