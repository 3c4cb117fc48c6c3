"""Every query with SQL, against DuckDB on the same tables; the others run."""

import duckdb
import pytest

from engramspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, con, sf, name):
    df = plans.QUERIES[name](spark, sf)
    got = con.execute(plans.SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    order = [cols.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).collect() is not None


@pytest.mark.parametrize("name", ["recall_weighted_topk", "edge_expand_1hop", "multi_angle_merge"])
def test_arrival_order_does_not_matter(spark, sf, name, tmp_path):
    from pyspark.sql import functions as F

    for t in ("documents", "labels", "orders"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).orderBy(F.rand(7)).write.parquet(f"{tmp_path}/{t}.parquet")
    one, two = (sorted(map(str, plans.QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert one == two


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
