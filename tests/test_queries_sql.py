"""Queries against their SQL on made-up tables of odd texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as X
from plumbline.functions import text as Y
from plumbline.plans.queries import ORACLE_SQL, QUERIES

TEXTS = ["", "12 34", "é", "\n", "a b", ".", "Über of the thing. No thing.", "thing", "no thing. With thing", "Of the ering and the tion. by the thble", "ßa thing. ßb with thing", "ᾳab and the tion", "ŉab with erble", "straße of the erble ering with tion"]


@pytest.fixture(scope="module")
def same(spark, tmp_path_factory):
    """Whether a query has the rows of its SQL; the texts in turn get each finding, label and split."""
    folder = str(tmp_path_factory.mktemp("odd"))
    n = 12 * len(TEXTS)
    duck = duckdb.connect()
    tables = {"documents": ([(i, TEXTS[i // 12], "en", "s", len(TEXTS[i // 12])) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(i, i // 3 % 2, i // 6 % 2) for i in range(n)], "doc_id long, quality int, toxic int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")

    def check(name):
        df, sql = QUERIES[name](spark, folder), duck.execute(ORACLE_SQL[name])
        at = [[d[0] for d in sql.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())

    return check


def test_risk_signals(same):
    same("risk_signals")


def test_build_summary(same):
    same("build_summary")


def test_dpo_records(same):
    same("dpo_records")


def test_clean_rationale_words(same, spark):
    same("clean_rationale_words")
    letters = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = dict(letters.where("length(c) = 1").select("c", Y.capital(F.col("c"))).collect())
    want = dict(duckdb.execute("select chr(i::int), upper(chr(i::int)) from range(1, 65536) t(i) where i not between 55296 and 57343").fetchall())
    assert {c for c in got if got[c] != want[c]} <= set("\u019b\u0264\u1c8a\ua7cd\ua7db")  # capitals of Unicode 16


def test_margins_adaptive(same, spark):
    same("margins_adaptive")
    odd = spark.range(1, 20000, 2).select((F.col("id") / 20000.0).alias("x")).select("x", X.rounded(F.col("x"), 4).alias("y"))
    assert duckdb.execute("select round(0.27595::double, 4)").fetchone() == odd.where("x = 0.27595").select("y").first() == (0.2759,)
    want = duckdb.execute("select round(i / 20000.0::double, 4) from range(1, 20000, 2) t(i) order by i").fetchall()
    assert [r.y for r in odd.orderBy("x").collect()] == [y for (y,) in want]


def test_margins_fixed(same):
    same("margins_fixed")


def test_margins_uncertainty(same):
    same("margins_uncertainty")
