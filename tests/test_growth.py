"""What has to stay small when tables grow."""

from pyspark.sql import functions as F


def test_dense_blocks_are_few():
    from faultline.operators.retrieval import blocks_of

    # every block is sent to all blocks of the other side
    assert blocks_of(2_000, 64) == 1 and blocks_of(262_144, 64) == 8
    assert blocks_of(600_000, 64) == 19 and blocks_of(600_000, 100_000) == 147
    assert blocks_of(0, 1) == 1


def test_a_projected_line_does_not_grow_with_its_host(spark, tmp_path):
    from faultline.plans import catalog

    catalog.queries()
    rows = [(1, 5, "view"), (2, 20, "error"), (3, 21, "click"), (4, 2_000_000_000, "signup")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("value", F.lit(1.0)).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["path"]: r["preview"] for r in catalog.QUERIES["projected_events"](spark, str(tmp_path)).collect()}
    assert got == {"host5": "x" * 205, "host20": "x" * 220, "host21": "x" * 220 + "…", "host2000000000": "x" * 220 + "…"}


def test_root_chain_shuffles_matched_causes_only(spark):
    """Codes of many causes, by incidents with few and with many patterns."""
    from faultline.operators import patterns

    n = 70
    edges = [("ORA-1", f"P{k:02}", "caused_by", 0.1 + k / 100) for k in range(n)] + [("ORA-2", "P03", "caused_by", 0.5), ("P03", "P02", "triggered_by", 0.2), ("P69", "P68", "triggered_by", 0.3)]
    edges = spark.createDataFrame(edges, "source string, target string, type string, probability double")
    codes = spark.createDataFrame([(1, "ORA-1"), (1, "ORA-2"), (2, "ORA-1"), (3, "ORA-2"), (1, "ORA-2")], "incident int, id string")
    matched = [(1, "P03"), (1, "P02"), (1, None), (3, "P04"), (4, "P03")] + [(2, f"P{k:02}") for k in range(n)]
    matched = spark.createDataFrame(matched, "incident int, pattern_id string")
    out = patterns.root_chain(codes, matched, edges)
    want = [(1, "ORA-1", "ROOT: P02 > OS: P03 > DB: ORA-1"), (1, "ORA-2", "ROOT: P02 > OS: P03 > DB: ORA-2"), (2, "ORA-1", "ROOT: P68 > OS: P69 > DB: ORA-1")]
    assert sorted((r["incident"], r["code"], r["causal_chain"]) for r in out.collect()) == want
    # of an incident's codes all causes met, and only then were tested, after a shuffle of them all
    assert "array_contains" in out._jdf.queryExecution().optimizedPlan().toString()


def test_drill_down_reads_its_edges_once(spark):
    from faultline.operators import patterns

    edges = spark.range(4).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"))
    out = patterns.reachable(edges, spark.createDataFrame([("n0",)], "id string"), 3)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()  # not derived again in each hop
    assert sorted((r["reached"], r["hops"]) for r in out.collect()) == [("n0", 0), ("n1", 1), ("n2", 2), ("n3", 3)]


def _block_errors(spark):
    line = F.concat(F.lit("2024-01-01T00:00:0"), "id", F.lit("Z host1 kernel: blk_update_request: I/O error, dev sdb, sector "), "id")
    return spark.range(3).select(F.col("id").alias("incident"), F.concat(F.lit("f"), "id").alias("path"), line.alias("text"))


def test_the_router_derives_its_texts_once(spark):
    from faultline.plans.ingest import normalized_events

    events = normalized_events(_block_errors(spark))
    assert "Range" not in events._jdf.queryExecution().optimizedPlan().toString()  # not derived again by each parser
    assert sorted((r["source_path"], r["code"]) for r in events.collect()) == [(f"f{k}", "OS_BLOCK_IO_ERROR") for k in range(3)]


def test_a_diagnosis_routes_its_files_once(spark):
    from faultline.plans.diagnose import diagnose

    out = diagnose(_block_errors(spark))
    both = out["report"].join(out["analysis"], "incident")
    assert "syslog_parser" not in both._jdf.queryExecution().optimizedPlan().toString()  # routed before, once for both
    assert both.count() == 3


def test_keyword_scores_are_made_part_by_part(spark, monkeypatch):
    import math

    from faultline.operators import retrieval

    monkeypatch.setattr(retrieval, "PART", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    texts = {k: " ".join(f"w{(k * j) % 7}x" for j in range(1, k % 5 + 3)) for k in range(20)}
    asked = {"a": "w1x w2x w1x", "b": "w3x", "c": "nothing here", "d": "w0x w6x"}
    out = retrieval.bm25(spark.createDataFrame(list(asked.items()), "query_id string, text string"), spark.createDataFrame(list(texts.items()), "chunk_id long, text string"))
    # a task held sums of all chunks of its share, however many there were
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    words = {k: t.split() for k, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    score = lambda q, w: sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in q.split())
    want = {(q, k): round(score(text, w), 4) for q, text in asked.items() for k, w in words.items() if round(score(text, w), 4) > 0}
    got = {(r["query_id"], r["chunk_id"]): r["bm25_score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-4 for x in want)


def test_fixes_are_counted_in_tasks_of_bounded_rows(spark, tmp_path):
    from faultline.plans import catalog
    from faultline.plans.frames import TASK_ROWS, dealt

    assert dealt(spark.range(9), 10 * TASK_ROWS + 1, "id").rdd.getNumPartitions() == 11
    assert dealt(spark.range(9), 9, "id").rdd.getNumPartitions() == 4  # the session's
    catalog.queries()
    pairs = [(1, 1), (1, 2), (1, 1), (2, 3), (2, None), (None, 1), (None, None), (1, 10)]
    spark.createDataFrame(pairs, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "b1"), (3, "b3")], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["graph_fixes"](spark, str(tmp_path))
    want = [("S1", "P10", 1, None, 1), ("S1", "P2", 1, None, 2), ("S1", "P1", 2, "b1", 3)]
    assert sorted((tuple(r) for r in out.where("pattern_id = 'S1'").collect()), key=lambda r: r[-1]) == want
    # a scan's tasks counted pairs of whole splits, and adaptive execution joined what came of them by bytes
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [source" in plan and plan.index("Aggregate [source") < plan.index("RepartitionByExpression [source")
