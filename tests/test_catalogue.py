import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from querl import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TYPED:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = sorted([tuple(map(plain, r)) for r in got.collect()], key=str)
    b = sorted([tuple(plain(r[i]) for i in order) for r in want.fetchall()], key=str)
    assert a == b
    kinds = {c: str(t) for c, t in zip(want.columns, want.types)}
    for f in got.schema:
        t = f.dataType.simpleString()
        assert kinds[f.name].lower() == {"int": "integer", "string": "varchar"}.get(t, t), f.name


def test_results_are_not_empty(spark):
    few = {n for n in catalogue.QUERIES if not catalogue.QUERIES[n](spark, SF).head(1)}
    assert few <= {"tpch_q19_variant"}


def test_truncation_differs_from_rounding(spark):
    r = catalogue.QUERIES["agg_avg_trunc"](spark, SF).first()
    assert isinstance(r["q"], Decimal)


def test_cyclic_join_has_all_customers(spark, duck):
    [want] = duck.sql("select count(*), count(distinct c_custkey) from customer, supplier, nation where c_nationkey = s_nationkey and s_nationkey = n_nationkey").fetchall()
    got = catalogue.QUERIES["join_cyclic"](spark, SF)
    assert (got.count(), got.select("c_custkey").distinct().count()) == want


def test_cyclic_join_is_dealt_over_tasks(spark):
    got = catalogue.QUERIES["join_cyclic"](spark, SF)  # each of its tables is one file, read by one task
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism
    assert max(n for _, n in tasks) < 2 * min(n for _, n in tasks)
