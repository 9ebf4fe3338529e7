import itertools
import math

import duckdb

from faultline.llm import mixing
from faultline.llm.mixing import OP2_SQL, mix_sources, op2_mix_sources, poisson_steps

from .conftest import DOCUMENT


def test_against_sql_with_odd_rows(spark, tables):
    rows = [(k, "w " * (k % 40), "en", f"s{k % 5 if k % 3 else 0}", 1) for k in range(400)]
    rows += [(7, "w " * 7, "en", "s2", 1), (None, "x", None, None, None), (900, None, "de", "", 3)]
    folder = tables(documents=(rows, DOCUMENT))
    got = sorted(map(str, map(tuple, op2_mix_sources(spark, folder).collect())))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(OP2_SQL).fetchall()))


def test_meets_target_weights(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "repeat('a', 9) as text", "if(id % 4 = 0, 'b', 'a') as source", "id as copies", "id as rate")
    mixed = mix_sources(docs, {"a": 1.0, "b": 9.0})
    share = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(share["b"] - 18000) < 600 and abs(share["a"] - 2000) < 200


def test_empty_and_zero_weights(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x", 1)], DOCUMENT)
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, {"y": 1.0}).count() == 0


def test_steps_are_the_distribution(spark):
    rates = [("a", 0.001), ("b", 3.7), ("c", 40.0), ("d", 1e6)]
    for r in poisson_steps(spark.createDataFrame(rates, "source_key string, rate double")).collect():
        assert r["steps"] == sorted(r["steps"]) and abs(r["steps"][-1] - 1) < 1e-12 and len(r["steps"]) < 60 + 21 * r["rate"] ** 0.5
        p = [math.exp(k * math.log(r["rate"]) - r["rate"] - math.lgamma(k + 1)) for k in range(r["first"], r["first"] + len(r["steps"]))]
        assert max(abs(x - y) for x, y in zip(itertools.accumulate(p), r["steps"])) < 1e-7


def test_large_rates_and_clashing_columns(spark):
    docs = spark.range(1001).selectExpr(
        "id as doc_id", "if(id = 0, 'x', repeat('a', 1999)) as text", "if(id = 0, 'b', 'a') as source", "'mine' as copy", "id as rate", "id as _mix_steps", "id as _MIX_u", "id as copies"
    )
    mixed = mix_sources(docs, {"a": 1.0, "b": 1.0})
    assert mixed.columns == ["doc_id", "text", "source", "_mix_steps", "_MIX_u", "copies", "copy", "rate"]
    n, distinct, top = mixed.where("doc_id = 0").selectExpr("count(*)", "count(distinct copy)", "max(copy)").first()
    assert n == distinct == top + 1 and abs(n - 500_000) < 5 * 708
    same = mix_sources(docs.where("doc_id > 0"), columns=False)
    assert same.columns == docs.columns and same.where("copy <> 'mine' or rate <> doc_id").count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000, "en", "x", 1)] * 2, DOCUMENT)
    assert mix_sources(long, {"x": 1.0}).groupBy("copy").count().where("count <> 2").count() == 0


def test_many_sources_are_joined_in_parts(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('a', 9) as text", "concat('s', id % 7) as source")
    want = sorted(map(tuple, mix_sources(docs).select("doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mix_sources(docs).select("doc_id", "copy").collect())) == want
