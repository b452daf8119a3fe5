"""The named queries: statements of the dialect over typed tables, and DuckDB SQL for the same rows.

The Parquet tables hold doubles and timestamps; TYPED gives every column its type in the dialect, and
both engines read the tables through the same casts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querl.engine import Engine
from querl.functions import types as ty
from querl.sources import loader, render

MONEY = "decimal(12,2)"
TYPED = {
    "region": {"r_regionkey": "int", "r_name": "char(25)"},
    "nation": {"n_nationkey": "int", "n_name": "char(25)", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "varchar(25)", "c_nationkey": "int", "c_acctbal": MONEY, "c_mktsegment": "char(10)"},
    "supplier": {"s_suppkey": "bigint", "s_name": "char(25)", "s_nationkey": "int", "s_acctbal": MONEY},
    "part": {"p_partkey": "bigint", "p_name": "char(55)", "p_brand": "char(10)", "p_type": "varchar(25)", "p_size": "int", "p_retailprice": MONEY},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "char(1)", "o_totalprice": MONEY, "o_orderdate": "date", "o_orderpriority": "char(15)"},
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": MONEY, "l_extendedprice": MONEY,
        "l_discount": MONEY, "l_tax": MONEY, "l_returnflag": "char(1)", "l_linestatus": "char(1)", "l_shipdate": "date",
    },
}


def typed_engine(spark: SparkSession, sf_dir: str, statement: str | None = None) -> Engine:
    """An Engine over the driver's tables, or those of them that ``statement`` names."""
    engine = Engine(spark)
    words = None if statement is None else set(re.findall(r"\w+", statement))
    for name, columns in TYPED.items():
        if words is not None and name not in words:
            continue
        declared = {c: ty.parse(t) for c, t in columns.items()}
        raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cast = [F.col(c).cast(t.spark).alias(c) if not isinstance(t.spark, T.StringType) else F.col(c) for c, t in declared.items()]
        engine.catalog.register(name, raw.select(*cast), declared)
    return engine


def _oracle_tables(sql: str) -> str:
    """CTEs t_NAME with the casts of TYPED for the tables that ``sql`` names."""
    parts = []
    for name, columns in TYPED.items():
        if f"t_{name}" in sql:
            casts = [c if "char" in t else f"CAST({c} AS {t.upper()}) AS {c}" for c, t in columns.items()]
            parts.append(f"t_{name} AS (SELECT {', '.join(casts)} FROM {name})")
    return f"WITH {', '.join(parts)} " if parts else ""


@dataclass
class Query:
    """A statement, its DuckDB form over t_NAME tables, and output casts both sides take."""

    statement: str
    oracle: str
    out: dict[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = typed_engine(spark, sf_dir, self.statement).execute(self.statement).planned
        columns = [F.col(n).cast(f"decimal(38,{t.scale})").alias(n) if t.tag == "decimal" else F.col(n) for n, t in planned.columns.items()]
        return planned.rows.select(*columns)

    def sql(self) -> str:
        inner = _oracle_tables(self.oracle)
        if not self.out:
            return inner + self.oracle
        return f"{inner}SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in self.out.items())}) FROM ({self.oracle}) AS q"


def dec(scale: int) -> str:
    return f"DECIMAL(38,{scale})"


def _same(statement: str, **out: str) -> Query:
    """A query whose DuckDB form differs in the table names only."""
    oracle = statement
    for name in TYPED:
        oracle = oracle.replace(f"from {name}", f"from t_{name}").replace(f", {name}", f", t_{name}")
    return Query(statement, oracle, out)


def _avg(c: str, scale: int) -> str:
    """DuckDB: the truncated average of decimals of ``scale``."""
    d = scale + 2
    return f"CAST(CAST(CAST(sum({c}) * 1{'0' * d} AS DECIMAL(38,0)) AS HUGEINT) // count(*) AS DECIMAL(38,{d})) / 1{'0' * d}"


def _avg_out(scale: int) -> str:
    return dec(scale + 2)


REVENUE = "sum(l_extendedprice * (1 - l_discount))"

CATALOGUE: dict[str, Query] = {
    "scan_all": _same("select * from nation"),
    "scan_pruned": _same("select l_orderkey, l_quantity from lineitem", l_quantity=dec(2)),
    "from_less_select": Query("select 1+2 as a, 1.5*2.25 as b, 7/2 as c, 'x' as d", "SELECT CAST(3 AS BIGINT) AS a, CAST(3.375 AS DECIMAL(38,3)) AS b, CAST(3 AS BIGINT) AS c, 'x' AS d"),
    "filter_decimal_or": _same("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 3.0 or l_quantity > 48.5", l_quantity=dec(2)),
    "filter_decimal_scale_mix": _same("select l_orderkey, l_extendedprice from lineitem where l_extendedprice < 1234.5678", l_extendedprice=dec(2)),
    "filter_date_range": Query(
        "select o_orderkey, o_orderdate from orders where o_orderdate >= date '1996/06/15' and o_orderdate <= date '1998-10-25'",
        "SELECT o_orderkey, o_orderdate FROM t_orders WHERE o_orderdate >= DATE '1996-06-15' AND o_orderdate <= DATE '1998-10-25'",
    ),
    "filter_combined": Query(
        "select l_orderkey, l_quantity, l_discount from lineitem where l_discount < 0.05 and (l_shipdate < date '1996-01-01' or l_quantity < 12)",
        "SELECT l_orderkey, l_quantity, l_discount FROM t_lineitem WHERE l_discount < 0.05 AND (l_shipdate < DATE '1996-01-01' OR l_quantity < 12)",
        {"l_quantity": dec(2), "l_discount": dec(2)},
    ),
    "filter_between": _same("select l_orderkey, l_discount from lineitem where l_discount between 0.06 - 0.01 and 0.06 + 0.01", l_discount=dec(2)),
    "filter_in_list": _same("select p_partkey, p_size from part where p_size in (1, 4, 9, 16, 25) or p_brand in ('Brand#1', 'Brand#7')"),
    "filter_like_prefix": _same("select p_partkey, p_type from part where p_type like 'PROMO%'"),
    "filter_like_suffix": _same("select p_partkey, p_type from part where p_type like '%UM'"),
    "filter_like_infix": _same("select p_partkey, p_type from part where p_type like '%ND%'"),
    "filter_like_underscore": _same("select p_partkey, p_brand from part where p_brand like 'Brand#_'"),
    "filter_neq": _same("select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'"),
    "filter_equal": _same("select l_orderkey, l_tax from lineitem where l_tax = 0.020 and l_linenumber = 3", l_tax=dec(2)),
    "filter_greater_equal": _same("select c_custkey, c_acctbal from customer where c_acctbal >= 9000 and c_acctbal > 0.5", c_acctbal=dec(2)),
    "filter_char_blank_eq": Query(
        "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING  '",
        "SELECT c_custkey, c_mktsegment FROM t_customer WHERE rtrim(c_mktsegment, ' ') = 'BUILDING'",
    ),
    "filter_varchar_eq": _same("select c_custkey, c_name from customer where c_name = 'Customer#7' or c_name <> 'Customer#7'"),
    "filter_mixed_numbers": _same("select p_partkey, p_size from part where p_size < 20.5 and p_retailprice >= 100 and 1 <> 2"),
    "project_negative": _same("select l_orderkey, -1 * l_linenumber as a, -0.5 * l_tax as b from lineitem", a="BIGINT", b=dec(3)),
    "project_commented": Query("select n_name -- of a nation; 'all'\nfrom nation -- of them", "SELECT n_name FROM t_nation"),
    "project_arith": _same("select l_orderkey, l_extendedprice + l_tax as a, l_extendedprice - l_discount as b, l_extendedprice * l_discount as c, l_linenumber + 1 as d from lineitem", a=dec(2), b=dec(2), c=dec(4), d="BIGINT"),
    "project_int_div": Query("select o_orderkey / 7 as q, (0 - o_orderkey) / 7 as n from orders", "SELECT o_orderkey // 7 AS q, CAST(trunc(-(o_orderkey // 7)) AS BIGINT) AS n FROM t_orders"),
    "project_cast_trunc": Query(
        "select l_orderkey, (l_extendedprice * l_discount) :: decimal(12,1) as a, l_extendedprice :: bigint as b, l_linenumber :: decimal(12,2) as c from lineitem",
        "SELECT l_orderkey, CAST(trunc((l_extendedprice * l_discount) * 10) AS DECIMAL(38,0)) / 10 AS a, CAST(trunc(l_extendedprice) AS BIGINT) AS b, l_linenumber AS c FROM t_lineitem",
        {"a": dec(1), "c": dec(2)},
    ),
    "project_case": _same(
        "select l_orderkey, case when l_quantity < 10 then l_tax when l_quantity < 20 then 1 else l_discount end as a, case when l_returnflag = 'R' then 1 else 0 end as b from lineitem",
        a=dec(2), b="BIGINT",
    ),
    "project_alias": _same("select n_name as nation_name, n_regionkey as region from nation"),
    "join_hash_equi": _same("select o_orderkey, l_linenumber, l_quantity from orders, lineitem where o_orderkey = l_orderkey", l_quantity=dec(2)),
    "join_unique_key": _same("select n_name, r_name from nation, region where n_regionkey = r_regionkey"),
    "join_composite": _same("select s_suppkey, c_custkey from supplier, customer where s_nationkey = c_nationkey and s_suppkey = c_custkey"),
    "join_expr_key": _same("select o_orderkey, c_custkey from orders, customer where o_custkey + 1 = c_custkey"),
    "join_cyclic": _same(
        "select c_custkey, s_suppkey, n_name from customer, supplier, nation where c_nationkey = s_nationkey and s_nationkey = n_nationkey and c_nationkey = n_nationkey"
    ),
    "join_theta": _same("select n_nationkey, r_regionkey from nation, region where n_nationkey < r_regionkey"),
    "join_cross": _same("select n_name, r_name from nation, region"),
    "join_multiway": _same(
        "select n_name, sum(l_quantity) as q from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and c_nationkey = n_nationkey group by n_name", q=dec(2)
    ),
    "join_residual_filter": _same("select o_orderkey, l_linenumber from orders, lineitem where o_orderkey = l_orderkey and (l_quantity < 2 or o_totalprice > 400000)"),
    "agg_group_sum": _same("select l_returnflag, sum(l_quantity) as q from lineitem group by l_returnflag", q=dec(2)),
    "agg_group_expr": _same("select l_linenumber + l_suppkey as k, sum(l_linenumber + l_suppkey) as s from lineitem group by l_linenumber + l_suppkey", s="BIGINT"),
    "agg_global": _same("select sum(l_quantity) as q, count(*) as n from lineitem", q=dec(2)),
    "agg_distinct_groups": _same("select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus"),
    "agg_count_star_expr": _same("select l_linestatus, count(*) as n, count(l_orderkey) as m from lineitem group by l_linestatus"),
    "agg_avg_trunc": Query(
        "select l_returnflag, avg(l_quantity) as q, avg(l_discount) as d, avg(l_linenumber) as n from lineitem group by l_returnflag",
        f"SELECT l_returnflag, {_avg('l_quantity', 2)} AS q, {_avg('l_discount', 2)} AS d, {_avg('l_linenumber', 0)} AS n FROM t_lineitem GROUP BY l_returnflag",
        {"q": _avg_out(2), "d": _avg_out(2), "n": _avg_out(0)},
    ),
    "agg_min_max": _same("select l_returnflag, min(l_extendedprice) as a, max(l_extendedprice) as b, min(l_shipdate) as c, max(l_orderkey) as d from lineitem group by l_returnflag", a=dec(2), b=dec(2)),
    "agg_expr_over_agg": _same("select l_returnflag, 100.00 * sum(l_discount) + sum(l_quantity) as x from lineitem group by l_returnflag", x=dec(4)),
    "order_multi_key": _same("select o_orderstatus, o_orderkey, o_totalprice from orders order by o_orderstatus desc, o_totalprice, o_orderkey", o_totalprice=dec(2)),
    "limit_plain": Query("select 1 as one from lineitem limit 17", "SELECT CAST(1 AS BIGINT) AS one FROM t_lineitem LIMIT 17"),
    "topk": _same("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", o_totalprice=dec(2)),
    "tpch_q1": Query(
        f"""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price, {REVENUE} as sum_disc_price,
            sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as sum_charge, avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count(*) as count_order
            from lineitem where l_shipdate <= date "1998-9-02" group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
        f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, {REVENUE} AS sum_disc_price,
            sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, {_avg('l_quantity', 2)} AS avg_qty, {_avg('l_extendedprice', 2)} AS avg_price, {_avg('l_discount', 2)} AS avg_disc, count(*) AS count_order
            FROM t_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
        {"sum_qty": dec(2), "sum_base_price": dec(2), "sum_disc_price": dec(4), "sum_charge": dec(6), "avg_qty": dec(4), "avg_price": dec(4), "avg_disc": dec(4)},
    ),
    "tpch_q3": Query(
        f"""select l_orderkey, {REVENUE} as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
            and o_orderdate < date '1997-03-15' and l_shipdate > date '1997-03-15' group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
        f"""SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM t_customer, t_orders, t_lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
            AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        {"revenue": dec(4)},
    ),
    "tpch_q5": Query(
        f"""select n_name, {REVENUE} as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey
            and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1998-01-01'
            group by n_name order by revenue desc""",
        f"""SELECT n_name, {REVENUE} AS revenue FROM t_customer, t_orders, t_lineitem, t_supplier, t_nation, t_region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
            AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""",
        {"revenue": dec(4)},
    ),
    "tpch_q6": Query(
        """select sum(l_extendedprice * l_discount) as revenue from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'
           and l_discount between 0.06 - 0.01 and 0.06 + 0.01 and l_quantity < 24""",
        """SELECT sum(l_extendedprice * l_discount) AS revenue FROM t_lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
           AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
        {"revenue": dec(4)},
    ),
    "tpch_q10": Query(
        f"""select c_custkey, c_name, {REVENUE} as revenue, c_acctbal, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey
            and o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-04-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
            group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
        f"""SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM t_customer, t_orders, t_lineitem, t_nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
            AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-04-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
            GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        {"revenue": dec(4), "c_acctbal": dec(2)},
    ),
    "tpch_q12_variant": Query(
        """select l_linestatus, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as high_line_count,
           sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as low_line_count
           from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('A', 'R') and o_orderdate < l_shipdate and l_shipdate >= date '1996-01-01' and l_shipdate < date '1998-01-01'
           group by l_linestatus order by l_linestatus""",
        """SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
           FROM t_orders, t_lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus""",
        {"high_line_count": "BIGINT", "low_line_count": "BIGINT"},
    ),
    "tpch_q14": Query(
        f"""select 100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) + {REVENUE} as promo_revenue
            from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-12-01'""",
        f"""SELECT 100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) + {REVENUE} AS promo_revenue
            FROM t_lineitem, t_part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-12-01'""",
        {"promo_revenue": dec(6)},
    ),
    "tpch_q19_variant": _same(
        """select l_extendedprice * (1 - l_discount) as revenue from lineitem, part where p_partkey = l_partkey and l_returnflag in ('A', 'N')
           and ((p_brand = 'Brand#12' and l_quantity >= 1 and l_quantity <= 1 + 10 and p_size between 1 and 15)
             or (p_brand = 'Brand#23' and l_quantity >= 10 and l_quantity <= 10 + 10 and p_size between 1 and 30)
             or (p_brand = 'Brand#4' and l_quantity >= 20 and l_quantity <= 20 + 10 and p_size between 1 and 45))""",
        revenue=dec(4),
    ),
}


def _customers_as_text(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """An engine with an empty table ``loaded`` for customers, and a folder of customers in the dialect's text form."""
    engine = typed_engine(spark, sf_dir, "customer")
    table = engine.catalog.get("customer")
    path = f"{loader.stored_root(spark)}/querl-text/{uuid.uuid4().hex}"
    render.write_file(table.rows, table.columns, path)
    engine.execute("create table loaded (" + ", ".join(f"{c} {t}" for c, t in table.columns.items()) + ")")
    return engine, path


def bulk_insert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in the dialect's text form and loaded back by bulk insert."""
    engine, path = _customers_as_text(spark, sf_dir)
    engine.execute(f'bulk insert loaded from "{path}" with (fieldterminator="|")')
    rows = engine.execute("select * from loaded").planned.rows
    return rows.select("c_custkey", F.rtrim("c_name").alias("c_name"), "c_nationkey", F.col("c_acctbal").cast("decimal(38,2)").alias("c_acctbal"), F.rtrim("c_mktsegment").alias("c_mktsegment"))


def agg_char_blank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a fixed-length column of which one load is padded and another isn't: values equal but for blanks are one group."""
    engine, path = _customers_as_text(spark, sf_dir)
    engine.execute(f'bulk insert loaded from "{path}" with (fieldterminator="|")')
    engine.catalog.append("loaded", engine.catalog.get("customer").rows)
    return engine.execute("select c_mktsegment, count(*) as n from loaded group by c_mktsegment").planned.rows


def bulk_insert_firstrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions from a file with two lines above the rows, which firstrow passes over."""
    engine = typed_engine(spark, sf_dir, "region")
    table = engine.catalog.get("region")
    body = [r["value"] for r in render.rows_as_text(table.rows.orderBy("r_regionkey"), table.columns).collect()]
    path = f"{loader.stored_root(spark)}/querl-text/{uuid.uuid4().hex}"
    spark.createDataFrame([("\n".join(["key|name|", "above the rows", *body]),)], "value string").coalesce(1).write.text(path)
    engine.execute("create table loaded (r_regionkey int, r_name varchar(25))")
    engine.execute(f'bulk insert loaded from "{path}" with (fieldterminator="|", firstrow=3)')
    return engine.execute("select * from loaded").planned.rows.select("r_regionkey", F.rtrim("r_name").alias("r_name"))


BULK_ORACLE = Query("", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM t_customer", {"c_acctbal": dec(2)})

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q.run for n, q in CATALOGUE.items()} | {
    "bulk_insert_roundtrip": bulk_insert_roundtrip,
    "agg_char_blank_groups": agg_char_blank_groups,
    "bulk_insert_firstrow": bulk_insert_firstrow,
}
ORACLE_SQL: dict[str, str] = {n: q.sql() for n, q in CATALOGUE.items()} | {
    "bulk_insert_roundtrip": BULK_ORACLE.sql(),
    "agg_char_blank_groups": "SELECT c_mktsegment, 2 * count(*) AS n FROM customer GROUP BY c_mktsegment",
    "bulk_insert_firstrow": "SELECT r_regionkey, r_name FROM region",
}
