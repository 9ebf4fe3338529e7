import datetime as dt

from pyspark.sql import functions as F

from faultline.functions.time import infer_years, line_time
from faultline.operators import chunking
from faultline.operators import parsers as P
from faultline.plans.ingest import normalized_events


def files(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def at(*x):
    return dt.datetime(*x)


def times(spark, line, year=None):
    r = spark.createDataFrame([(line,)], "line string").select(line_time(F.col("line"), F.lit(year).cast("int")).alias("t")).first()["t"]
    return r["ts"], r["raw"], r["confidence"]


def test_timestamps(spark):
    assert times(spark, "2024-03-07T02:44:18.5+05:30 host x")[0] == at(2024, 3, 6, 21, 14, 18, 500000)
    assert times(spark, "x 2024-03-07 02:44:18 y")[0] == at(2024, 3, 7, 2, 44, 18)
    assert times(spark, "Thu Mar  7 02:44:18 2024") == (at(2024, 3, 7, 2, 44, 18), "Thu Mar  7 02:44:18 2024", "HIGH")
    assert times(spark, "at 07-MAR-2024 02:44:18")[0] == at(2024, 3, 7, 2, 44, 18)
    assert times(spark, "3/7/2024 02:44:18")[0] == at(2024, 3, 7, 2, 44, 18)
    assert times(spark, "2024/3/7 02:44:18")[0] == at(2024, 3, 7, 2, 44, 18)
    assert times(spark, "Mar  7 02:44:18 host x") == (None, "Mar  7 02:44:18", "LOW")
    assert times(spark, "Mar  7 02:44:18 host x", 2024) == (at(2024, 3, 7, 2, 44, 18), "Mar  7 02:44:18", "MEDIUM")
    assert times(spark, "nothing")[0] is None


def test_year_inference(spark):
    lines = P.lines_of(files(spark, a="Mar 7 02:44:18 h k: x\n2023-05-01 00:00:00 y\n2024-05-01 00:00:00 z", b="none"))
    assert rows(infer_years(lines), "path", "year") == [("a", 2023)]


def test_syslog(spark):
    text = "lost line\nMar  7 02:44:18 db1 kernel: sd 2:0:0:1: hostbyte=DID_TIME_OUT blk_update_request: I/O error, dev sdb, sector 99\n more of it\n2024-03-07T02:44:19Z db1 multipathd[77]: mpatha: remaining active paths: 0\n[  12.5] Out of memory"
    out = P.parse_syslog(P.lines_of(files(spark, m=text))).orderBy("line_number")
    got = rows(out, "line_number", "host", "process", "pid", "format", "timestamp")
    assert [g[:5] for g in got] == [(2, "db1", "kernel", None, "RFC3164"), (4, "db1", "multipathd", "77", "RFC5424"), (5, None, "kernel", None, "DMESG")]
    assert got[0][5] is None and got[1][5] == at(2024, 3, 7, 2, 44, 19)
    assert "more of it" in out.first()["message"]
    codes = rows(P.syslog_events(out).orderBy("line_number", "code"), "line_number", "code", "severity", "device", "block")
    assert codes == [(2, "OS_BLOCK_IO_ERROR", "ERROR", "sdb", "99"), (2, "SCSI_DISK_TIMEOUT", "CRITICAL", "sdb", "99"), (4, "MULTIPATH_ALL_PATHS_DOWN", "CRITICAL", None, None), (5, "OS_OOM_KILLER", "CRITICAL", None, None)]


ALERT = """Thu Mar  7 02:44:18 2024
Errors in file /u01/diag/trace/db_lgwr_12.trc (incident=4711):
ORA-27072: File I/O error
Linux-x86_64 Error: 5: Input/output error
Additional information: 4
ORA-00312: online log 2 thread 1: '/redo/log2.rdo'
ORA-00353: log corruption near block 6732 change 1 time 03/07/2024 02:40:00
LGWR (ospid: 1234): terminating the instance due to error 353
Thu Mar  7 02:45:00 2024
all is well"""


def test_alert_blocks(spark):
    r = P.parse_alert_blocks(P.lines_of(files(spark, a=ALERT))).orderBy("block").collect()
    assert [x["severity"] for x in r] == ["ERROR", "INFO"]
    assert r[0]["ora_codes"] == ["ORA-27072", "ORA-00312", "ORA-00353"] and r[0]["errno"] == "5"
    assert (r[0]["trace_path"], r[0]["incident_path"], r[0]["incident_id"]) == ("/u01/diag/trace/db_lgwr_12.trc", "/u01/diag/trace", "4711")
    critical = P.parse_alert_blocks(P.lines_of(files(spark, a="Thu Mar  7 02:44:18 2024\nORA-15130: diskgroup"))).first()
    assert critical["severity"] == "CRITICAL"


def test_sql_dump_is_cut(spark):
    text = "Thu Mar  7 02:44:18 2024\nORA-00600: x\nCurrent SQL statement:\n" + "\n".join(f"select {k}" for k in range(100)) + "\n\nORA-07445: y"
    r = P.parse_alert_blocks(P.lines_of(files(spark, a=text))).first()
    assert len(r["lines"]) < 15 and any("TRUNCATED" in x for x in r["lines"]) and r["ora_codes"] == ["ORA-00600", "ORA-07445"]


def test_alert_events(spark):
    e = P.alert_events(P.lines_of(files(spark, a=ALERT))).orderBy("line_number").collect()
    assert [(x["line_number"], x["code"]) for x in e] == [(3, "ORA-27072"), (4, "OS_ERRNO_5"), (6, "ORA-00312"), (7, "ORA-00353"), (8, "LGWR_INSTANCE_TERMINATION")]
    assert all(x["timestamp"] == at(2024, 3, 7, 2, 44, 18) for x in e)  # embedded times don't move it
    assert e[0]["os_errno"] == "5" and e[0]["role_hint"] == "DB_IO_SYMPTOM" and e[0]["failure_family"] == "IO"
    assert (e[2]["redo_group"], e[2]["redo_thread"], e[2]["file_path"]) == ("2", "1", "/redo/log2.rdo")
    assert e[3]["details"]["corruption_time"] == "03/07/2024 02:40:00" and e[3]["severity"] == "CRITICAL"
    assert e[4]["mapped_code_hint"] == "ORA-00353" and e[4]["process"] == "LGWR"


def test_cells_and_asm(spark):
    text = (
        "2024-03-07T02:44:10+05:30 cell01 CELLSRV: warningCode=FLASH_IO_TIMEOUT flashDisk=FD_01 cellDisk=CD_03\n detail line\n2024-03-07T02:44:11 MS: no alerts in this interval\n"
        "2024-03-07T02:44:12 CELLSRV: Read Failed. group:1 disk:2 AU:3 offset:4 size:5\n2024-03-07T02:44:13 RS: FD_02 on CD_09 requires replacement\n2024-03-07T02:44:14 MS: hello"
    )
    got = P.cell_events(P.lines_of(files(spark, c=text))).orderBy("line_number").collect()
    assert [(g["code"], g["severity"]) for g in got] == [("FLASH_IO_TIMEOUT", "CRITICAL"), ("STORAGE_ASM_READ_FAILED", "ERROR"), ("STORAGE_MEDIA_READ_FAILURE", "CRITICAL"), ("CELL_INFORMATIONAL", "INFO")]
    assert got[0]["cell"] == "cell01" and got[0]["flash_disk"] == "FD_01" and "detail line" in got[0]["message"] and got[1]["au"] == "3"
    asm = "ORA-15130: diskgroup DATA is being dismounted\ncache dismounting group 2 (DATA)\nRead Failed. group:1 disk:2 AU:3 offset:4 size:5\nsaw ORA-15080 and ORA-15081"
    codes = sorted(rows(P.asm_events(P.lines_of(files(spark, a=asm))), "line_number", "code"))
    assert codes == [(2, "ASM_DISMOUNT_PROGRESS"), (3, "ASM_READ_FAILED"), (4, "ORA-15080"), (4, "ORA-15081")]


def test_cluster_and_aix(spark):
    text = "2024-03-07 02:44:18.123456 [CSSD]CRS-1618: Node node2 is not responding\n2024-03-07 02:44:19.1 [CRSD] Start of resource 'ora.db' succeeded CRS-2676\nnoise"
    got = P.parse_crs(P.lines_of(files(spark, c=text))).orderBy("line_number").collect()
    assert [(g["crs_code"], g["severity"], g["is_eviction"], g["is_false_positive"]) for g in got] == [("CRS-1618", "CRITICAL", True, False), ("CRS-2676", "INFO", False, True)]
    assert got[0]["affected_node"] == "node2" and got[0]["timestamp"] == at(2024, 3, 7, 2, 44, 18, 123456) and got[1]["resource_name"] == "ora.db"
    errpt = "LABEL:\t\tDISK_ERR7\nIDENTIFIER:\tDE3B8540\n\nDate/Time:       Mon Apr 21 03:14:18 IST 2024\nNode Id:         aix1\nClass:           H\nType:            PERM\nResource Name:   hdisk2\n\nDescription\nDISK OPERATION ERROR\n---------------\nnothing"
    r = P.parse_errpt(files(spark, e=errpt)).collect()
    assert len(r) == 1 and (r[0]["severity"], r[0]["os_pattern"], r[0]["category"], r[0]["resource"], r[0]["timestamp"]) == ("CRITICAL", "SCSI_DISK_TIMEOUT", "DISK", "hdisk2", at(2024, 4, 21, 3, 14, 18))
    records = P.parse_records(P.lines_of(files(spark, r="name: a\nsize: 1\n\nname: b"))).orderBy("record").collect()
    assert [x["fields"] for x in records] == [{"name": "a", "size": "1"}, {"name": "b"}]


def test_metrics(spark):
    io = "Device: rrqm/s wrqm/s r/s w/s rkB/s wkB/s avgrq-sz avgqu-sz await r_await w_await svctm %util\nsdb 0.00 0.10 82 120 3280 4800 79.5 1.2 6.0 5.5 6.4 5.8 96.7\nDevice r/s w/s rkB/s wkB/s rrqm/s wrqm/s %rrqm %wrqm r_await w_await aqu-sz %util\nsdc 1 2 3 4 5 6 7 8 250.0 9.0 1.0 50.0"
    assert rows(P.parse_iostat(P.lines_of(files(spark, i=io))).orderBy("line_number"), "device", "await_ms", "util_pct", "iops", "severity") == [("sdb", 6.0, 96.7, 202.0, "CRITICAL"), ("sdc", 250.0, 50.0, 3.0, "ERROR")]
    vm = " 9 0 0 400000 1 1 600 0 1 2 3 4 85 2 3 40 0\n1 0 0 900000 1 1 0 0 1 2 3 4 5 2 93 0"
    assert rows(P.parse_vmstat(P.lines_of(files(spark, v=vm))).orderBy("line_number"), "severity", "patterns") == [("CRITICAL", ["MEMORY_SWAP_STORM", "IO_QUEUE_TIMEOUT", "CPU_RUNQUEUE_SATURATION"]), ("INFO", [])]
    peaks = P.parse_osw(P.lines_of(files(spark, o="zzz ***Mon Mar 07 03:14:01 IST 2024\n" + vm))).first()
    assert peaks["sample_count"] == 2 and peaks["osw_signals"] == ["CPU_SATURATION", "MEMORY_PRESSURE", "LOW_PHYSICAL_MEMORY", "IO_WAIT_HIGH", "CPU_USER_HIGH"]
    df = "/dev/a 200G 200G 0 100% /arch\ntmpfs 1 1 0 100% /x\n/dev/b 1 1 0 96% /u"
    assert rows(P.parse_df(P.lines_of(files(spark, d=df))).orderBy("line_number"), "os_pattern", "severity") == [("FILESYSTEM_ARCH_FULL", "CRITICAL"), ("FILESYSTEM_ANY_FULL", "ERROR")]
    sar = "03:10:01 AM     all      5.21    0.00     1.82     0.12    25.40   3.45\n03:10:01 AM 0 1 1 1 1 1 1"
    assert rows(P.parse_sar_cpu(P.lines_of(files(spark, s=sar))), "severity", "patterns") == [("CRITICAL", ["CPU_STEAL_TIME", "CPU_RUNQUEUE_SATURATION"])]
    assert rows(P.parse_exawatcher(P.lines_of(files(spark, x="ib0 3 0 1\nib1 0 0 0\nib2 4 0 0"))).orderBy("line_number"), "port", "severity") == [("ib0", "CRITICAL"), ("ib2", "WARNING")]


def test_awr(spark):
    text = (
        "WORKLOAD REPOSITORY report\nElapsed: 60.00 (mins)\nDB Time: 1,200.50 (mins)\nTop 10 Foreground Events by Total Wait Time\n"
        "latch: shared pool            32,454   4,521.3    139.3   59.5  Concurrency\ndb file sequential read      198,321   1,234.5      6.2   16.2  User I/O\nlatch: shared pool            1   1.0    1.0   9.5  Concurrency\n"
        "tiny wait   1   1.0    1.0   0.1  Other\nShared Pool Free (%)        8.2\nSQL ordered by Elapsed Time\nabcdefghijk12 12.5 3.5 x hard parses"
    )
    r = P.parse_awr(files(spark, a=text)).first()
    assert r["db_time_ratio"] == 20.01 and [e["event"] for e in r["top_wait_events"]] == ["latch: shared pool", "db file sequential read"]
    assert r["awr_signals"] == ["SHARED_POOL_CONTENTION", "IO_SINGLE_BLOCK", "SHARED_POOL_EXHAUSTION", "HIGH_HARD_PARSE", "DB_TIME_SPIKE", "DB_TIME_CRITICAL"] and r["top_sql"] == ["abcdefghijk12"]


def test_trace_security_audit(spark):
    text = "Trace file x\nProcess ID: 11\nInstance name: db1\n----- Call Stack -----\nksedmp()+1\nmain()\n----------------------\nProcess ID: 12\n----- Error Stack -----\n" + "\n".join(f"l{k}" for k in range(40))
    r = P.parse_trace(P.lines_of(files(spark, t=text))).select("*", P.highlighted_frames(F.col("sections")["call_stack"]).alias("h")).first()
    assert r["pid"] == "12" and r["instance_name"] == "db1" and r["sections"]["call_stack"] == "ksedmp()+1\nmain()" and r["h"] == ["ksedmp()+1"]
    assert len(r["sections"]["error_stack"].split("\n")) == 30
    secure = "sshd: Failed password for root from 1.2.3.4 port 22 ssh2\nsudo: bob : TTY=x ; PWD=/ ; USER=root ; COMMAND=/bin/ls\nORA-01017: invalid username/password\nfine"
    assert rows(P.parse_security(P.lines_of(files(spark, s=secure))).orderBy("line_number"), "event_type", "severity") == [("ssh_failed", "WARNING"), ("sudo_exec", "INFO"), ("AUTH_FAILURE", "ERROR")]
    a = P.parse_audit(files(spark, a="ACTION : [5] 'LOGON'\nUSERID : [3] 'BOB'\nRETURNCODE : [4] '1017'", b="ACTION: GRANT DBA RETURNCODE: 0")).orderBy("path").collect()
    assert [(x["event_type"], x["severity"], x["userid"]) for x in a] == [("AUTH_FAILURE", "ERROR", "BOB"), ("PRIVILEGE_CHANGE", "INFO", None)]


def test_router(spark):
    texts = files(
        spark, alert=ALERT, messages="Mar  7 02:44:18 db1 kernel: rejecting I/O to offline device sdb\n2024-01-01 00:00:00 something failed badly", wrapped='{"logs":[{"name":"inner.log","text":"ORA-00600: internal"},{"name":"x"}]}', empty="  ",
    )
    e = normalized_events(texts)
    assert e.columns[0] == "event_id" and len(e.columns) == 56
    rows_ = e.collect()
    got = {(r["source_path"], r["line_number"], r["code"], r["parser_name"]) for r in rows_}
    assert ("alert", 3, "ORA-27072", "alert_log_parser") in got and ("messages", 1, "DEVICE_OFFLINE", "syslog_parser") in got
    assert ("messages", 2, "GENERIC_FAILURE_LINE", "generic_evidence_parser") in got
    assert ("inner.log", 1, "ORA-00600", "alert_log_parser") in got
    assert len({r["event_id"] for r in rows_}) == len(rows_)
    dated = next(r for r in rows_ if r["source_path"] == "messages" and r["line_number"] == 1)
    assert dated["timestamp"] == at(2024, 3, 7, 2, 44, 18) and dated["timestamp_confidence"] == "MEDIUM"
    assert next(r for r in rows_ if r["source_path"] == "inner.log")["details"]["wrapper_source"] == "wrapped"


def test_texts_are_dealt_before_their_lines(spark):
    files = spark.createDataFrame([(f"f{k}", "a\nb\na") for k in range(9)], "path string, text string")
    out = P.blocks(P.lines_of(files), F.col("line") == "a").groupBy("path", "block").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert out.count() == 18


def test_blocks_with_and_without_traces_are_cut_alike(spark):
    sizes = [1, 49, 50, 51, 96, 97, 98, 144, 200]
    lines = [[f"line {k}" for k in range(n)] for n in sizes] + [["Call Trace:"] + [f"x {k}" for k in range(60)], [f"line at {k}" for k in range(97)]]
    rows = [("f", i, own, "\n".join(own)) for i, own in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, block int, lines array<string>, raw string").selectExpr(
        "*", "'ERROR' severity", "array('ORA-00600') ora_codes", "null timestamp", "string(block) timestamp_raw", "'' errno", "null trace_path", "null incident_id", "null incident_path")
    got = sorted((int(r.keywords[0][4:]), r.line_count, r.raw_text) for r in chunking.alert_chunks(df, "c").collect())
    want = []
    for i, own in enumerate(lines):
        held = []
        for line in own:
            held.append(line)
            if len(held) >= 50 and own[0] != "Call Trace:":
                want.append(held)
                held = held[-3:]
        want += [held] if held else []
    assert got == sorted((600, len(w), "\n".join(w)) for w in want)


def test_syslog_entries_are_parsed_once_after_grouping(spark):
    text = "  lost\nMar  7 02:44:18 db1 kernel: first\n  more \n\n\tand more\nFeb 30 02:44:18 db1 su[7]: no such day\n2024-03-07T02:44:19+01:00 db1 x[8]: iso\n2024-13-07T02:44:19Z db1 y: bad\n[ 1.5] boot\nlast"
    lines = P.lines_of(files(spark, a=text, b=text)).drop("n_lines")
    out = P.parse_syslog(lines, spark.createDataFrame([("a", 2024)], "path string, year int"))
    got = rows(out.where("path = 'a'").orderBy("line_number"), "line_number", "timestamp", "timestamp_raw", "timestamp_confidence", "process", "pid", "message", "format")
    assert got == [
        (2, at(2024, 3, 7, 2, 44, 18), "Mar  7 02:44:18", "MEDIUM", "kernel", None, "first more \tand more", "RFC3164"), (6, None, "Feb 30 02:44:18", "MEDIUM", "su", "7", "no such day", "RFC3164"),
        (7, at(2024, 3, 7, 1, 44, 19), "2024-03-07T02:44:19+01:00", "HIGH", "x", "8", "iso", "RFC5424"), (8, None, "2024-13-07T02:44:19Z", "LOW", "y", None, "bad", "RFC5424"), (9, None, "[1.5]", "LOW", "kernel", None, "boot last", "DMESG"),
    ]
    assert out.where("path = 'a'").orderBy("line_number").first()["raw"] == "Mar  7 02:44:18 db1 kernel: first\n  more \n\tand more"
    assert rows(out.where("path = 'b'").orderBy("line_number"), "timestamp", "timestamp_confidence")[:3] == [(None, "LOW"), (None, "LOW"), (at(2024, 3, 7, 1, 44, 19), "HIGH")]
    # every time form was tried on every line, in one expression, and twice
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 30
