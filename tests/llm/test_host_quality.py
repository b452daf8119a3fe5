import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querl.llm import host_quality as hq


def spark_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def duck_rows(rows, columns):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"})
    con.register("documents", frame)
    return sorted([tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({hq.ORACLE_SQL})").fetchall()], key=str)


@pytest.fixture(scope="module")
def rows():
    good = " ".join(f"word{i}" for i in range(60))
    bad = "buy now " * 40
    out = [(0, None, None), (1, "", "a"), (2, " \n\t", "a"), (3, good + "\n" + good, "a"), (None, good, None), (4, "a b c a b c", "a"), (4, "a b c a b c", "a")]
    out += [(10 + i, bad, "spam.example") for i in range(30)] + [(50, good, "spam.example")]
    out += [(60 + i, good + f" x{i} # $ %\nsame line\nsame line\n\n\n", "fine.example") for i in range(30)]
    out += [(100, "w x   é\x0by " * 3000, "long.example")]
    return out


def test_against_sql(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("x")).withColumn("n_words", F.lit(-1))
    got = hq.judge(df)
    assert spark_rows(got) == duck_rows(rows, got.columns)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not kept[50] and kept[60] and not kept[10]


def test_empty_table(spark):
    assert hq.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_main_path_has_no_python(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("h").alias("source"))
    plan = hq.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
