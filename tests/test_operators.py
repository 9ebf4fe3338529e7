import datetime as dt
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import chunking, core, correlation, patterns, reasoning, retrieval, sessions
from faultline.plans import diagnose
from faultline.sources import archives as A
from faultline.sources import files as S

D = dt.datetime(2024, 3, 7, 10, 0, 0)
CHUNK = "chunk_id string, hostname string, log_source string, timestamp_start timestamp_ntz, category string, severity string, ora_code string"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


def linked(spark, stored, reference, topology=()):
    chunks = spark.createDataFrame([stored, reference], CHUNK)
    hosts = spark.createDataFrame(list(topology), "cluster_name string, host string")
    out = correlation.temporal_correlation(chunks.where(F.col("chunk_id") == reference[0]), chunks, hosts)
    return [r["correlated_id"] for r in out.collect()]


def test_correlation_cases(spark):
    rac = [("c", "CELL01"), ("c", "dbnode01")]
    assert linked(spark, ("s", "cell01", "OS", D, "OS", "CRITICAL", ""), ("r", "dbnode01", "ALERT_LOG", D + dt.timedelta(seconds=15), "ORACLE", "ERROR", "ORA-27072"), rac) == ["s"]
    assert linked(spark, ("s", "dbnode02", "OS", D - dt.timedelta(hours=4), "DISK", "ERROR", ""), ("r", "dbnode02", "ALERT_LOG", D, "ORACLE", "ERROR", "ORA-01578")) == ["s"]
    assert linked(spark, ("s", "dbnode02", "OS", D - dt.timedelta(hours=25), "DISK", "ERROR", ""), ("r", "dbnode02", "ALERT_LOG", D, "ORACLE", "ERROR", "ORA-01578")) == []
    assert linked(spark, ("s", "h", "OS", D, "DISK", "ERROR", ""), ("r", "h", "ALERT_LOG", D + dt.timedelta(seconds=10), "ORACLE", "ERROR", "ORA-00942")) == []
    assert linked(spark, ("s", "h", "OS", D + dt.timedelta(seconds=60), "APP", "ERROR", ""), ("r", "h", "X", D, "ORACLE", "ERROR", "")) == ["s"]
    assert linked(spark, ("s", "h", "OS", D + dt.timedelta(seconds=61), "OS", "ERROR", ""), ("r", "h", "X", D, "ORACLE", "ERROR", "")) == []


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("See ORA-27072, a B c_d!"))) == ["see", "ora-27072", "c_d"]
    assert one(spark, T.keywords(F.lit("sdb failed: ORA-00600 error"))) == ["ORA-00600", "error", "failed", "sdb"]
    text = "Thread 1 advanced to log sequence 5\nORA-00600: Thread 1 advanced to log sequence\nother"
    assert one(spark, T.strip_benign_lines(F.lit(text), [r"Thread \d+ advanced"])) == "ORA-00600: Thread 1 advanced to log sequence\nother"
    assert one(spark, T.strip_benign_lines(F.lit("Thread 1 advanced"), [r"Thread \d+ advanced"])) == ""
    assert one(spark, T.bundle_class(F.array(F.lit("multipath -ll")))) == "DIAGNOSTIC"
    assert one(spark, T.bundle_class(F.array(F.lit("df -h"), F.lit("recover database until cancel")))) == "DESTRUCTIVE_DBA_APPROVAL_REQUIRED"
    assert one(spark, T.bundle_class(F.array().cast("array<string>"))) == "DIAGNOSTIC"
    assert one(spark, T.strip_html(F.lit("<p>a &amp; b</p><br/>c\n\n\n\nd"))) == "a & b\n\nc\n\nd"
    assert one(spark, T.finite(F.lit(float("nan")))) == 0.0 and one(spark, T.clean(F.lit("a\0bc"), 2)) == "ab"


def test_rotated_files(spark):
    names = ["messages", "messages.1", "messages-20240421.gz", "alert_orcl.log", "alert_orcl.log.1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").groupBy(T.rotation_base(F.col("n")).alias("b")).count()
    assert {r["b"]: r["count"] for r in df.collect()} == {"messages": 3, "alert_orcl": 2}


def entries(spark, times, texts=None):
    return spark.createDataFrame([("f", i, D + dt.timedelta(seconds=t) if t is not None else None, (texts or {}).get(i, f"line {i}")) for i, t in enumerate(times)], "path string, line_number int, timestamp timestamp, raw string")


def windows(df, **k):
    out = chunking.anchored_windows(df, ["path"], "timestamp", ["line_number"], 60, **k)
    got = {}
    for r in out.collect():
        got.setdefault(r["window"], []).append(r["line_number"])
    return [sorted(got[w]) for w in sorted(got)]


def test_anchored_windows(spark):
    # measured from the window's start, not from the entry before
    assert windows(entries(spark, [0, 40, 60, 61, 100, 122])) == [[0, 1, 2], [3, 4], [5]]
    assert windows(entries(spark, [0, 60, 60.5])) == [[0, 1], [2]]
    assert windows(entries(spark, list(range(10))), most=5, overlap=2) == [[0, 1, 2, 3, 4], [3, 4, 5, 6, 7], [6, 7, 8, 9]]
    assert windows(entries(spark, [0, 100, 200], {0: "Call Trace:", 1: "  at foo", 2: "  at bar"}), trace="raw") == [[0, 1, 2]]


def test_syslog_chunks(spark):
    rows = [("f", i, D + dt.timedelta(seconds=i), "h", "disk error on sdb" if i == 3 else "fine", f"raw {i}") for i in range(5)] + [("f", 9, D + dt.timedelta(hours=1), "h", "fine", "raw 9")]
    c = chunking.syslog_chunks(spark.createDataFrame(rows, "path string, line_number int, timestamp timestamp, host string, message string, raw string"), "c1").collect()
    assert len(c) == 1 and c[0]["severity"] == "ERROR" and c[0]["line_count"] == 5 and c[0]["keywords"] == ["error", "sdb"] and len(c[0]["chunk_id"]) == 16


def test_alert_chunks(spark):
    schema = "path string, block int, line_number int, timestamp timestamp, timestamp_raw string, ora_codes array<string>, errno string, trace_path string, incident_path string, incident_id string, severity string, lines array<string>"
    trace = ["ORA-00600: x", "Call Trace:"] + [f"  at f{k}" for k in range(70)]
    plain = [f"l{k}" for k in range(97)]
    rows = [("a", 1, 1, D, "t", ["ORA-00600"], None, None, None, None, "ERROR", trace), ("a", 2, 90, D, "t", [], None, None, None, None, "CRITICAL", plain), ("a", 3, 200, D, "t", [], None, None, None, None, "INFO", ["x"])]
    got = sorted((r["ora_code"], r["line_count"]) for r in chunking.alert_chunks(spark.createDataFrame(rows, schema), "c").collect())
    assert got == [("", 3), ("", 50), ("", 50), ("ORA-00600", 72)]
    strides = spark.createDataFrame([(97,), (50,), (49,), (0,)], "n int").select("n", F.size(chunking.strided_chunks(F.col("n"))).alias("k")).collect()
    assert {r["n"]: r["k"] for r in strides} == {97: 3, 50: 2, 49: 1, 0: 0}


def test_shared_bus(spark):
    rows = [(f"c{k}", "OS", D, f"sd{k}", f"text {k}", 1, "", "ERROR") for k in range(4)] + [("c9", "OS", D + dt.timedelta(seconds=5), "sdz", "t", 1, "", "ERROR")]
    df = spark.createDataFrame(rows, "chunk_id string, category string, timestamp_start timestamp, device string, raw_text string, line_count int, os_pattern string, severity string")
    got = {r["chunk_id"]: r for r in chunking.merge_shared_bus(df).collect()}
    assert set(got) == {"SUPER-c0", "c9"} and got["SUPER-c0"]["os_pattern"] == "SYSTEM_BUS_RESET" and got["SUPER-c0"]["line_count"] == 4


def test_patterns_and_rules(spark, tmp_path):
    rules = {
        "A": {"match_any": ["timeout", "reset"], "match_all": ["disk", "abort"], "exclude": ["ready"], "log_sources": ["MESSAGES"], "severity": "CRITICAL", "device_extract": r"dev (sd\w+)", "ora_codes_triggered": ["ORA-15080"]},
        "B": {"match_any": ["timeout", "never"], "severity": "ERROR"}, "_false_positives": ["log switch"], "_metric_patterns": {"HOT": {"field": "util", "operator": ">=", "threshold": 95, "severity": "CRITICAL"}},
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    known, benign, metrics = patterns.load_rules(str(path))
    rows = [("1", "VAR_LOG_MESSAGES", "disk abort TIMEOUT dev sdb ORA-00600"), ("2", "X", "disk timeout"), ("3", "MESSAGES", "timeout ready disk abort"), ("4", "MESSAGES", "log switch timeout"), ("5", "MESSAGES", "only timeout")]
    got = {(r["chunk_id"], r["pattern_id"]): r for r in patterns.match(spark.createDataFrame(rows, "chunk_id string, log_source string, raw_text string"), known, benign).collect()}
    assert got["1", "A"]["confidence"] == 100 and got["1", "A"]["device"] == "sdb" and got["1", "A"]["ora_codes"] == ["ORA-15080", "ORA-00600"]
    assert got["5", "A"]["confidence"] == 32 and got["5", "B"]["confidence"] == 90
    assert ("2", "A") not in got and ("3", "A") not in got and not any(k[0] == "4" for k in got)
    hot = patterns.metric_hits(spark.createDataFrame([(1, 96.0), (2, 90.0)], "id int, util double"), metrics).collect()
    assert [(r["id"], r["pattern_id"]) for r in hot] == [(1, "HOT")]


def test_overrides(spark):
    def score(signals, root="", n=1, raw=""):
        return one(spark, reasoning.bucket_confidence(F.array(*[F.lit(s) for s in signals]).cast("array<string>"), F.lit(root), F.lit(n), F.lit(raw)))

    assert score([], "OS_KERNEL_PANIC")["score"] == 100
    assert score(["LAYER_NETWORK", "LAYER_DB"], "ORA-3136", 5)["label"] == "SUSPECTED" and score([], "ORA-3136", 150)["score"] == 100
    assert score(["LOG_FILE_SYNC", "CPU_SATURATION"])["overrides"] == ["STARVED_IO_THREAD"] and score(["LOG_FILE_SYNC", "CPU_SATURATION"])["score"] == 30
    assert score(["LAYER_OS_TRIGGERED"], "OS_OOM_KILLER", 1, "killed multipathd")["score"] == 100
    assert score(["LAYER_MEMORY", "LAYER_DB", "DB_TIME_CRITICAL", "DB_TIME_SPIKE"])["score"] == 45


def test_root_selection(spark):
    def root(layers, shown, oras):
        a = lambda x: F.array(*[F.lit(s) for s in x]).cast("array<string>")
        r = one(spark, reasoning.root_label(a(layers), a(shown), a(oras)))
        return r["root"], r["layer"]

    assert root(["DB", "ASM", "OS"], ["SCSI_DISK_TIMEOUT", "FC_HBA_RESET"], ["ORA-27072", "ORA-15080"]) == ("OS_STORAGE_PATH_FAILURE", "OS")
    assert root(["DB"], [], ["ORA-00312"]) == ("DB_OBJECT_LOCATOR_ONLY_NEEDS_CONTEXT", "DB")
    assert root(["DB"], [], ["ORA-27072", "ORA-00312", "ORA-00353"]) == ("DB_REDO_IO_FAILURE_NEEDS_LOWER_LAYER_EVIDENCE", "DB")
    assert root(["DB", "ASM"], [], ["ORA-27072", "ORA-15080"]) == ("ORA-15080", "ASM")
    assert root(["STORAGE", "DB"], [], ["ORA-27072"]) == ("STORAGE_FLASH_IO_OR_MEDIA_FAILURE", "STORAGE")
    assert root([], [], []) == ("NEEDS_MORE_INFO", "UNKNOWN")


def test_progressive_evidence(spark):
    steps = ["2024-03-07 02:44:18\nORA-27072: File I/O error\nORA-00353: log corruption near block 7", "2024-03-07 02:44:10 db1 kernel: x\n2024-03-07T02:44:10Z db1 kernel: rejecting I/O to offline device sdb", "2024-03-07T02:44:05 cell01 CELLSRV: flashcache read error flashDisk=FD_01\nRead Failed. group:1 disk:2 AU:3 offset:4 size:5"]
    files = spark.createDataFrame([(n, f"{n}-{k}", steps[k]) for n in (1, 2, 3) for k in range(n)], "incident int, path string, text string")
    scores = {r["incident"]: r for r in diagnose.diagnose(files)["analysis"].collect()}
    assert scores[1]["score"] < scores[2]["score"] <= scores[3]["score"]
    assert scores[1]["status"] == "SUSPECTED" and scores[3]["root_cause"] == "STORAGE_FLASH_IO_OR_MEDIA_FAILURE"


def test_report_gate(spark):
    schema = "mode string, primary_ora string, layers array<string>, oras array<string>, matched array<string>, best_pattern string, best_score double, best_label string, n_sources int, rca_status string, rca_score double, has_chain boolean, root_cause string"
    rows = [
        ("log_paste", "ORA-27072", ["DB", "OS", "STORAGE"], ["ORA-27072"], ["SCSI_DISK_TIMEOUT"], "SCSI_DISK_TIMEOUT", 90.0, "HIGH", 2, "LIKELY", 70.0, True, "a"),
        ("log_paste", "", ["DB"], [], [], None, None, None, 1, "SUSPECTED", 60.0, False, "a"), ("log_paste", "", ["DB", "OS"], [], ["X"], "Y", 90.0, "HIGH", 2, "SUSPECTED", 60.0, False, "a"),
        ("log_paste", "", ["DB"], [], [], None, None, None, 1, "CONFIRMED", 95.0, False, "a"), ("x", "", ["DB", "OS"], ["ORA-15080"], [], "SCSI_DISK_TIMEOUT", 90.0, "HIGH", 2, "LIKELY", 50.0, True, "a"),
    ]
    got = [(r["report_status"], r["no_match_reason"], r["root_cause"]) for r in reasoning.downgrade(reasoning.report_gate(spark.createDataFrame(rows, schema))).collect()]
    assert got == [("SUCCESS", None, "a"), ("NO_MATCH", "SINGLE_LAYER", "UNKNOWN"), ("NO_MATCH", "PATTERN_NOT_IN_EVIDENCE", "UNKNOWN"), ("SUCCESS", None, "a"), ("NO_MATCH", "NEEDS_INFRA_EVIDENCE", "UNKNOWN")]


def test_retrieval_pipeline(spark):
    docs = [("c1", "h1", "ALERT", D, "ORACLE", "ERROR", "ORA-27072", "disk read error on redo", "", [1.0, 0.0]), ("c2", "h1", "OS", D - dt.timedelta(seconds=30), "DISK", "CRITICAL", "", "scsi timeout", "SCSI_DISK_TIMEOUT", [0.9, 0.1]), ("c3", "h2", "OS", D, "OS", "ERROR", "", "all quiet", "", [0.0, 1.0])]
    schema = CHUNK + ", raw_text string, os_pattern string, embedding array<double>"
    chunks = spark.createDataFrame(docs, schema)
    q = spark.createDataFrame([(1, "disk read error", [1.0, 0.0])], "query_id int, text string, query_embedding array<double>")
    lib = spark.createDataFrame([("K", "SCSI_DISK_TIMEOUT", ["SCSI_DISK_TIMEOUT", "ORA-27072"])], "cascade_id string, root_pattern string, sequence array<string>")
    out = diagnose.retrieve(q, chunks.drop("embedding"), chunks.select("chunk_id", "embedding"), cascades=lib)
    top = out["fused"].orderBy("rank").first()
    assert top["chunk_id"] == "c1" and abs(top["rrf_score"] - 1 / 61) < 1e-12
    bonus = {r["chunk_id"]: r["temporal_bonus"] for r in out["bonuses"].collect()}
    assert bonus["c1"] == 10 and out["cascades"].first()["match_pct"] == 100.0
    assert one(spark, retrieval.confidence(F.lit(95), F.lit(18.2), F.lit(20.0), F.lit(0.89), F.lit(10))) == 88.1
    assert core.prefilter(chunks).count() == 3 and core.prefilter(chunks, fail_open=False).count() == 0
    assert core.prefilter(chunks, hostname="h1", severities=["CRITICAL"]).count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([("ORA-1", "A", "caused_by", 0.9), ("ORA-1", "B", "caused_by", 0.5), ("B", "C", "triggered_by", 0.7), ("A", "D", "triggered_by", 0.7)], "source string, target string, type string, probability double")
    codes = spark.createDataFrame([(1, "ORA-1"), (2, "ORA-1")], "incident int, id string")
    matched = spark.createDataFrame([(1, "B"), (1, "C")], "incident int, pattern_id string")
    got = patterns.root_chain(codes, matched, edges).collect()
    assert [(r["incident"], r["causal_chain"]) for r in got] == [(1, "ROOT: C > OS: B > DB: ORA-1")]
    more = patterns.add_edges(edges, edges.limit(1).unionByName(spark.createDataFrame([("X", "Y", "caused_by", 1.0)], edges.schema)))
    assert more.count() == 5 and patterns.reject_edges(more, more.where("source = 'X'")).count() == 4


def test_sessions_and_store(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "paste", "a", "one\nORA-00600: x"), (1, 1, "zip", "b", "zz"), (1, 2, "paste", "", "two " * 400)], "session_id int, turn int, kind string, label string, content string")
    whole = sessions.merged(turns).first()["text"]
    assert whole.startswith("# turn 1 kind=paste label=a\none") and "zz" not in whole and "# turn 3 kind=paste label=paste" in whole
    cut = sessions.merged(turns, 600).first()["text"]
    assert len(cut) <= 700 and "- [turn 1:a] ORA-00600: x" in cut
    files = spark.createDataFrame([("i1", "alert", "2024-03-07 02:44:18 x\nORA-27072: File I/O error")], "incident string, path string, text string")
    out = diagnose.diagnose(files)
    tables = sessions.diagnosis_tables(out["analysis"], out["events"], "run1")
    sessions.write_run(str(tmp_path / "store"), "run1", tables)
    sessions.write_run(str(tmp_path / "store"), "run1", tables)  # again: the same rows
    stored = sessions.read_store(spark, str(tmp_path / "store"), "incident_case")
    assert stored.count() == 1 and stored.first()["status"] == "SUSPECTED"
    assert "ts" in sessions.read_store(spark, str(tmp_path / "store"), "normalized_event").columns
    later = sessions.diagnosis_tables(out["analysis"], out["events"], "run2", sessions.read_store(spark, str(tmp_path / "store"), "correlation_run"))
    assert later["correlation_run"].first()["run_number"] == 2


def archive_bytes(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = archive_bytes([("deep/alert_x.log", b"ORA-00600: x")])
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("var/messages")
        info.size = 4
        t.addfile(info, io.BytesIO(b"line"))
    (tmp_path / "b.zip").write_bytes(archive_bytes([("a.log", b"text"), ("../evil", b"x"), ("bin", b"a\0b"), ("in.zip", inner), ("x.tar.gz", tar.getvalue()), ("big.txt", b"y" * 2000)]))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    got = {r["path"].split("!/", 1)[-1] if "!/" in r["path"] else r["path"].rsplit("/", 1)[-1]: (r["text"], r["skip_reason"]) for r in A.read_bundles(spark, str(tmp_path), S.Limits(text_bytes=1000)).collect()}
    assert got["a.log"] == ("text", None) and got["../evil"] == (None, "path_traversal_or_empty") and got["bin"][1] == "binary" and got["big.txt"][1] == "text_too_large"
    assert got["in.zip!/deep/alert_x.log"][0] == "ORA-00600: x" and got["x.tar.gz!/var/messages"][0] == "line" and got["broken.zip"][1].startswith("archive_open_failed")
    few = A.read_bundles(spark, str(tmp_path), S.Limits(files=1)).where("text is not null").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in few if "b.zip" in r["bundle"]] == ["alert_x.log"]


def test_structured_text(spark):
    lines = spark.createDataFrame([("m", k, x) for k, x in enumerate(["| Error | S | A |", "|---|---|---|", "| ORA-1 | a<br>b | do |", "| x | y |"])], "path string, line_number int, line string")
    assert [tuple(r)[2:] for r in S.markdown_tables(lines).collect()] == [("ORA-1", "a\nb", "do")]
    manual = spark.createDataFrame([("m", k, x) for k, x in enumerate(["intro", "ORA-00001: unique constraint", "*Cause: a duplicate", "key", "*Action: remove it", "ORA-00002: other"])], "path string, line_number int, line string")
    got = S.manual_messages(manual).orderBy("section").collect()
    assert (got[0]["code"], got[0]["cause"], got[0]["action"], got[0]["meaning"]) == ("ORA-00001", "a duplicate key", "remove it", "a duplicate key") and got[1]["meaning"] == "other"


def test_input_parsing(spark):
    rows = [(1, "ORA-27072 on dbhost01"), (2, "Mar  7 02:44:18 db1 kernel: blk_update_request x\nORA-00600"), (3, "why is the disk slow?"), (4, "Linux-x86_64 Error: 28: No space\n2024-03-07T02:44:18 ORA-1")]
    got = {r["query_id"]: r for r in diagnose.parse_input(spark.createDataFrame(rows, "query_id int, text string")).collect()}
    assert [got[k]["mode"] for k in (1, 2, 3)] == ["ora_code", "log_paste", "natural_language"]
    assert got[1]["hostname"] == "dbhost01" and got[2]["observed_layers"] == ["DB", "OS"] and got[4]["platform"] == "LINUX"
    assert one(spark, diagnose.errno(F.lit("Linux-x86_64 Error: 28: No space"), F.lit("LINUX")))["number"] == "28"
    assert one(spark, diagnose.platform(F.lit("x"), F.lit("/a/errpt.out"))) == "AIX"
    assert one(spark, diagnose.executable_command(F.lit("select 1 from dual"))) and not one(spark, diagnose.executable_command(F.lit("Cause: x Action: y")))


def test_streams(spark, tmp_path):
    from faultline.streaming import logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(f"Mar  7 02:{m:02d}:00 h{m % 2} kernel: disk error {m}" for m in (0, 1, 2, 30, 59)))
    stream = logs.syslog_stream(logs.read_line_stream(spark, str(tmp_path / "in")), 2024)
    q = logs.host_windows(stream, 3600).writeStream.outputMode("complete").format("memory").queryName("hosts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["host"]: r["count"] for r in spark.sql("select * from hosts").collect()} == {"h0": 3, "h1": 2}


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "temporal_correlation" in entry.queries()


def test_every_vector_is_asked(spark, tmp_path, monkeypatch):
    import numpy as np

    from faultline.operators import retrieval
    from faultline.plans import catalog

    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (60, 8)) + 0.25
    odd = [(60, None, 0), (61, [0.0] * 8, 0), (62, [float("nan")] * 8, 0), (63, [None] * 8, 0)]
    spark.createDataFrame([(k, row, 0) for k, row in enumerate(x.tolist())] + odd, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(k, f"disk error {k}") for k in range(9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, f"disk text number {k}", "en") for k in range(30)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    score = np.round(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2), 4)
    want = {q: sorted(range(60), key=lambda c: (-score[q, c], c)) for q in range(60)}
    got = catalog.QUERIES["cosine_topk_all"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["dense_score"]) for r in got) == [(q, n, c, score[q, c]) for q in range(60) for n, c in enumerate(want[q][:10])]
    fused = catalog.QUERIES["rrf_fusion_all"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in fused} == set(range(60)) and all(r["dense_rank"] in (0, *[want[r["query_id"]].index(r["chunk_id"]) + 1]) for r in fused)
    assert {r["query_id"] for r in fused if r["dense_rank"]} == set(range(60))
    assert catalog.QUERIES["confidence_score_all"](spark, str(tmp_path)).count() == len(fused)
