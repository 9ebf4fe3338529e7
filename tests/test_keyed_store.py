import random

import pytest
from faultline.operators.keyed_store import KeyedStore, Upsert, learn
from pyspark.sql import functions as F

COLUMNS = "k long, v string, n long, gone boolean"


def of(spark, rows):
    return Upsert(spark.createDataFrame(rows, COLUMNS), ("k",), ("n",), "gone")


def content(df):
    return {(r["k"], r["v"], r["n"]) for r in df.collect()}


def test_commits_equal_a_plain_replay(spark, tmp_path):
    store, r, best = KeyedStore(spark, f"file://{tmp_path}/s", buckets=4), random.Random(1), {}
    number = 0
    for _ in range(3):
        rows = []
        for _ in range(20):
            number += 1
            key, version = r.choice([None, *range(8)]), r.choice([number, 1000 - number])
            rows.append((key, f"v{number}", version, r.random() < 0.2))
        store.commit(t=of(spark, rows))
        for row in rows:
            if row[0] not in best or row[2] > best[row[0]][2]:
                best[row[0]] = row
        assert content(store.read("t")) == {row[:3] for row in best.values() if not row[3]}
    keys = spark.createDataFrame([(3,), (3,), (None,), (77,)], "k long")
    assert content(store.lookup("t", keys)) == {row[:3] for row in best.values() if not row[3] and row[0] in (3, None)}
    before = content(store.read("t"))
    assert store.vacuum() > 0 and content(store.read("t")) == before and store.vacuum() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", buckets=64)
    store.commit(t=of(spark, [(k, "a", 1, False) for k in range(200)]))
    first = store.manifest()["tables"]["t"]["at"]
    store.commit(t=of(spark, [(5, "b", 2, None), (5, "c", 1, False)]))
    second = store.manifest()["tables"]["t"]["at"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(second) == len(first)
    assert {x for x in content(store.read("t")) if x[0] == 5} == {(5, "b", 2)} and store.read("t").count() == 200


def test_broken_late_and_unlike_commits(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", buckets=4)
    store.commit(t=of(spark, [(1, "a", 1, False)]), u=of(spark, []))
    assert store.read("u").count() == 0
    staged = store.stage(t=of(spark, [(1, "lost", 9, False)]), u=of(spark, [(2, "lost", 9, False)]))
    assert content(store.read("t")) == {(1, "a", 1)} and store.read("u").count() == 0
    store.commit(t=of(spark, [(1, "same version", 1, False)]))
    assert content(store.read("t")) == {(1, "a", 1)}
    with pytest.raises(RuntimeError, match="another commit"):
        store.publish(staged)
    store.commit(t=Upsert(spark.createDataFrame([(1, 5)], "k int, n int"), ("k",), ("n",), "gone"))
    assert content(store.read("t")) == {(1, None, 5)}
    with pytest.raises(ValueError, match="no columns"):
        store.commit(t=Upsert(spark.createDataFrame([(1, 5, 0)], "k int, n int, more int"), ("k",), ("n",), "gone"))
    with pytest.raises(ValueError, match="stored with keys"):
        store.commit(t=Upsert(spark.createDataFrame([(1, 5)], "k int, n int"), ("n",), ("n",), "gone"))


def test_learning_twice(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", buckets=4)
    columns = "error_code string, log_snippet string, commands array<string>, platform string, category string, layer string, fix_tier string, hostname string, learned_at int"
    rows = [("ORA-00600", "x", ["a"], "aix", "db", "DB", "ASM", None, 1), ("ORA-00600", "y", ["b"], "beos", None, "?", None, "h", 2), (None, "z", [], None, None, None, None, None, 3)]
    for _ in range(2):
        learn(store, spark.createDataFrame(rows, columns))
    chunks = {(r["platform"], r["category"], r["hostname"], r["raw_text"]) for r in store.read("chunks").collect()}
    assert chunks == {("AIX", "DB", "unknown", "x"), ("UNKNOWN", "DB", "h", "y")}
    assert [(r["id"], r["commands"], r["layer"], r["fix_tier"]) for r in store.read("nodes").collect()] == [("oracle_ora_00600", ["b"], "DB", "Database")]
    assert store.read("chunks").select(F.min(F.length("chunk_id"))).first()[0] == 24
