import datetime
import random
from decimal import Decimal as D

import pytest

from querl.engine import Engine
from querl.errors import EngineError
from querl.functions import types as ty
from querl.operators import relational as ops
from querl.plans.syntax import split_statements
from querl.sources import render
from querl.streaming import stream_table


@pytest.fixture
def engine(spark):
    return Engine(spark)


def table(engine, name, columns, rows):
    engine.execute(f"create table {name} ({columns})")
    t = engine.catalog.get(name)
    engine.catalog.append(name, engine.spark.createDataFrame(rows, t.rows.schema))


def rows(engine, statement):
    return [tuple(r) for r in engine.execute(statement).rows.collect()]


def value(engine, expression):
    return rows(engine, f"select {expression} as x")[0][0]


def test_expressions(engine):
    assert value(engine, "11.111 + 321.12") == D("332.231")
    assert value(engine, "11.111 < 321.12") and not value(engine, "11.111 < 11.111") and not value(engine, "1.111 = 111.1")
    assert not value(engine, "12.3 > 13") and value(engine, "12.3 < 13") and value(engine, "90.99 * 0.33 < (120 + 285) * 0.1")
    assert value(engine, "date '2021/01/18'") == datetime.date(2021, 1, 18)
    assert value(engine, "-7 / 2") == -3 and value(engine, "1.999 :: decimal(4,1)") == D("1.9") and value(engine, "-1.999 :: bigint") == -1
    assert value(engine, "case when 1 = 2 then 1.5 else 2 end") == D("2.0") and value(engine, "case when 1 = 2 then 1 end") is None
    assert value(engine, "'ab  ' :: char(4) = 'ab'") and value(engine, "'a%b' like 'a\\%b'") is False
    with pytest.raises(EngineError):
        engine.execute("select 1 + 'ab' as x")


def test_selections(engine):
    table(engine, "t", "rate decimal(5,3), day date, quantity bigint", [(D("0.111"), datetime.date(1999, 1, 1), 500), (D("0.221"), datetime.date(2001, 1, 1), 119), (D("0.221"), datetime.date(2001, 1, 1), 120), (D("0.222"), datetime.date(1999, 1, 1), 1)])
    assert len(rows(engine, "select * from t where rate < 0.222 and (day < date '2000/01/01' or quantity < 120)")) == 2
    assert len(rows(engine, "select quantity from t where 1 = 2 and quantity > 0")) == 0


def test_joins(engine):
    a, b = [(1, 5), (2, 6), (2, 7), (3, 8), (4, 9), (2, 1)], [(2, 1), (2, 2), (3, 3), (9, 4), (1, 5), (8, 6)]
    table(engine, "r", "a bigint, b bigint", a)
    table(engine, "s", "c bigint, d bigint", b)
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0])
    assert sorted(rows(engine, "select * from r, s where a = c")) == want
    less = sorted((*x, *y) for x in a for y in b if x[0] < y[0])
    assert sorted(rows(engine, "select * from r, s where a < c")) == less
    assert len(rows(engine, "select a, c from r, s")) == 36
    r, s = engine.catalog.get("r").rows, engine.catalog.get("s").rows
    assert sorted(map(tuple, ops.hash_join(r, s, [("a", "c")]).collect())) == want
    assert sorted(map(tuple, ops.theta_join(r, s, r.a == s.c).collect())) == want
    assert ops.cross_product(r, s).count() == 36


def test_hash_join_equals_theta_join_on_random_rows(engine):
    rng = random.Random(1)
    table(engine, "x", "r_key bigint, r_value decimal(6,1)", [(i, D(rng.randint(0, 900)) / 10) for i in range(500)])
    table(engine, "y", "s_key bigint, s_value decimal(6,1)", [(i, D(rng.randint(0, 900)) / 10) for i in range(500)])
    joined = sorted(rows(engine, "select r_key, s_key from x, y where r_value = s_value"))
    assert joined == sorted(rows(engine, "select r_key, s_key from x, y where r_value <= s_value and r_value >= s_value")) and joined


def test_aggregations(engine):
    table(engine, "t", "a bigint, b bigint, c decimal(6,3)", [(i % 3, i % 2, D(i) / 8) for i in range(16)])
    assert sorted(rows(engine, "select a, sum(b) as s from t group by a")) == [(0, 3), (1, 3), (2, 2)]
    assert rows(engine, "select sum(c) as s, count(*) as n from t") == [(D("15.000"), 16)]
    assert len(rows(engine, "select a, b from t group by a, b")) == 6
    assert sorted(rows(engine, "select a + b as k, sum(a + b) as s from t group by a + b"))[0][0] == 0
    assert rows(engine, "select avg(a) as x, avg(c) as y from t where a > 5") == [(None, None)]
    assert rows(engine, "select avg(b) as x, min(c) as lo, max(c) as hi, 2 * count(a) + 1 as n from t") == [(D("0.50"), D("0.000"), D("1.875"), 33)]
    for bad in ("select a, sum(b) as s from t group by b", "select sum(sum(a)) as s from t", "select * from t group by a", "select sum(a) as s from t where sum(a) > 1"):
        with pytest.raises(EngineError):
            engine.execute(bad)


def test_truncating_average(engine):
    table(engine, "t", "v decimal(12,0)", [(D(380456),), *[(D(0),)] * 14875])
    assert rows(engine, "select avg(v) as x from t") == [(D("25.57"),)]
    table(engine, "u", "v decimal(4,2)", [(D("-1.00"),), (D("-1.01"),), (D("-1.00"),)])
    assert rows(engine, "select avg(v) as x from u") == [(D("-1.0033"),)]


def test_order_and_limit(engine):
    table(engine, "t", "a bigint, s varchar(5)", [(3, "b"), (1, "a"), (2, "b"), (1, "c")])
    assert rows(engine, "select s, a from t order by s desc, a") == [("c", 1), ("b", 2), ("b", 3), ("a", 1)]
    assert rows(engine, "select a from t order by a limit 2") == [(1,), (1,)] and rows(engine, "select a from t limit 0") == []
    with pytest.raises(EngineError):
        engine.execute("select a from t order by s")


def test_tables_and_names(engine):
    table(engine, "t", "a bigint", [(1,)])
    table(engine, "u", "a bigint, b bigint", [(1, 2)])
    for bad in ("create table t (x int)", "select * from nowhere", "select z from t", "select a from t, u", "select * from t, t", "select a, b as a from u", "select a from t where a"):
        with pytest.raises(EngineError):
            engine.execute(bad)
    assert "t: 1 attributes, 1 tuples" in engine.execute("tables").message


def test_bulk_insert(engine, tmp_path):
    (tmp_path / "x.tbl").write_text("k|name|day|v|\n1|alphabet|2020-01-31|.125|\n-2||2020/2/1|3|\n3|c|12/31/2020|1.5\n")
    engine.execute("create table t (k int, name char(5), day date, v decimal(6,2))")
    engine.execute(f'bulk insert t from "{tmp_path}/x.tbl" with (fieldterminator="|", firstrow=2)')
    assert sorted(rows(engine, "select * from t")) == [(-2, "", datetime.date(2020, 2, 1), D("3.00")), (1, "alpha", datetime.date(2020, 1, 31), D("0.12")), (3, "c", datetime.date(2020, 12, 31), D("1.50"))]
    planned = engine.execute("select * from t order by k limit 1").planned
    assert render.rows_as_text(planned.rows, planned.columns).first()[0] == "-2|     |2020/02/01|3.00|"
    assert "3 tuples" in engine.execute("select * from t").text()


@pytest.mark.parametrize("line", ["1,2", "1", "1,2,3,4", "x,2,3", "1,2020-02-30,1", "1,2020-01-01,1.x"])
def test_bad_lines(engine, tmp_path, line):
    (tmp_path / "x.csv").write_text(line + "\n")
    engine.execute("create table t (k int, day date, v decimal(4,1))")
    with pytest.raises(EngineError, match="a line has not|not a value"):
        engine.execute(f"bulk insert t from '{tmp_path}/x.csv'")
    assert rows(engine, "select count(*) as n from t") == [(0,)]  # nothing of a bad file is loaded


def test_loads_add_up_in_one_scan(engine, tmp_path):
    engine.execute("create table t (k int, name char(5))")
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"{k},ab\n")
        engine.execute(f"bulk insert t from '{tmp_path}/{k}.csv'")
    assert sorted(rows(engine, "select k from t where name = 'ab   '")) == [(0,), (1,), (2,)]
    plan = engine.execute("select k from t where name = 'ab'").rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "StringStartsWith(name,ab)" in plan


def test_fixed_length_groups(engine):
    table(engine, "t", "s char(4), v varchar(4)", [("ab", "ab"), ("ab  ", "ab  "), ("b", "b")])
    assert sorted(rows(engine, "select s, count(*) as n from t group by s")) == [("ab", 2), ("b", 1)]
    assert len(rows(engine, "select s from t group by s")) == 2 and len(rows(engine, "select v from t group by v")) == 3
    out = engine.execute("select s from t group by s").planned
    assert sorted(r[0] for r in render.rows_as_text(out.rows, out.columns).collect()) == ["ab  |", "b   |"]


def test_errors_at_run_time(engine):
    result = engine.execute("select 1 / (2 - 2) as x")
    for use in (result.text, result.fetch):
        with pytest.raises(EngineError):
            use()
    assert engine.execute("select 1 as x").fetch() == [(1,)]


def test_command_line(tmp_path, monkeypatch, capsys):
    from querl import __main__ as main

    (tmp_path / "startup.sql").write_text("create table t (a bigint);\n")
    monkeypatch.chdir(tmp_path)
    lines = iter(["select 1 / 0 as x;", "select z from t;", "select count(*) as n from t;", "q"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert main.main(["-i"]) == 0  # goes on after errors
    said = capsys.readouterr().out
    assert said.count("error:") == 2 and "1 tuples" in said
    assert main.main(["-x"]) == 2 and main.main(["-h"]) == 0


def test_time_of_planning_and_running(engine, capsys):
    engine.execute("showperf=true")
    assert engine.execute("select 1 as x").run_seconds > 0 and "run in" in capsys.readouterr().out
    engine.execute("showperf=false")


def test_bulk_insert_errors(engine, tmp_path):
    engine.execute("create table t (k int)")
    for bad in (f"bulk insert t from '{tmp_path}/none.csv'", f"bulk insert u from '{tmp_path}/none.csv'", "bulk insert t from 'x' with (fieldterminator='||')", "bulk insert t from 'x' with (color='red')"):
        with pytest.raises(EngineError):
            engine.execute(bad)


def test_scripts_and_controls(engine, tmp_path):
    assert split_statements("select ';' as x; -- a; b\nselect 2 as y;\n;") == ["select ';' as x", "select 2 as y"]
    script = tmp_path / "s.sql"
    script.write_text("create table t (a bigint);\nselect count(*) as n from t;\n")
    assert rows(engine, f"exec {script}") == [(0,)]
    engine.result_path = str(tmp_path / "out")
    assert engine.execute("tofile=true").message == "tofile=true" and engine.execute("threads=3").message == "threads=3"
    assert engine.execute("threads").message == "threads=3" and engine.execute("showperf").message == "showperf=false"
    engine.execute("select 1.50 as a, 'x' as b")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "1.50|x|\n"
    for bad in ("threads=0", "tofile=maybe", "exec nowhere.sql"):
        with pytest.raises(EngineError):
            engine.execute(bad)
    engine.execute("threads=4")
    engine.execute("tofile=false")


def test_streamed_table(engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,2.5\n2,3.5\n")
    stream_table(engine.catalog, "feed", f"{tmp_path}/in", {"k": ty.INT, "v": ty.decimal(5, 2)})
    planned = engine.execute("select k, sum(v) as s from feed where k > 0 group by k").planned
    query = planned.rows.writeStream.format("memory").queryName("feed_out").outputMode("complete").start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.csv").write_text("1,1.0\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, engine.spark.table("feed_out").collect())) == [(1, D("3.50")), (2, D("3.50"))]


def test_pushed_down_plans(engine):
    from querl.catalogue import typed_engine

    e = typed_engine(engine.spark, "/root/testdata/sf0.01")
    plan = e.execute("select n_name from nation, region where n_regionkey = r_regionkey and r_name = 'ASIA'").rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "HashJoin" in plan
    assert "StringStartsWith(r_name,ASIA)" in plan
