import json
import zipfile

from pyspark.sql import functions as F

from faultline.operators import evidence as E
from faultline.operators import parsers as P


def lines(spark, text):
    return P.lines_of(spark.createDataFrame([("f", text)], "path string, text string"))


def test_scanned_lines(spark):
    text = "short\nThu Mar  7 02:44:18 2024 LGWR: terminating instance ORA-00353 ora-00353\nRead Failed. group:1 disk:2 AU:33 offset:44 size:5 diskgroup DATA\n2024-03-07 02:44:18 nothing here\nLinux-x86_64 Error: 5: I/O error /dev/sdb"
    got = E.scan_lines(lines(spark, text)).orderBy("line_index").collect()
    assert [(r["line_index"], r["layer"], r["process"], r["severity"]) for r in got] == [(1, "DB", "LGWR", "CRITICAL"), (2, "ASM", "", "CRITICAL"), (4, "OS", "", "ERROR")]
    assert got[0]["ora_codes"] == ["ORA-00353", "ora-00353"] and got[0]["timestamp_raw"] == "Thu Mar  7 02:44:18"
    assert (got[1]["au"], got[1]["offset"], got[1]["diskgroup"]) == ("33", "44", "DATA") and (got[2]["os_errno"], got[2]["device"]) == ("5", "/sdb")


def test_normalized_events_come_first(spark):
    scanned = E.scan_lines(lines(spark, "ORA-27072: File I/O error\nkernel: something broke"))
    normalized = scanned.limit(1).withColumn("severity", F.lit("OWN"))
    got = E.merge_events(normalized, scanned).orderBy("line_index").collect()
    assert [r["severity"] for r in got] == ["OWN", "ERROR"]
    assert E.merge_events(normalized.limit(0), scanned).count() == 2


def test_meanings_and_hints(spark):
    rows = spark.createDataFrame([("ora-1", " m ", "x"), ("ora-2", " ", "x"), ("ora-3", None, E.PLACEHOLDER), ("ora-4", None, None)], "c string, m string, k string")
    got = [r[0] for r in rows.select(E.ora_meaning(F.col("c"), F.col("m"), F.col("k"))).collect()]
    assert got[:2] == ["m", "x"] and got[2].startswith("ORA-3: definition not in") and got[3].startswith("ORA-4")
    hints = spark.createDataFrame([("redo is slow",), ("",)], "t string").select(E.language_hints(F.col("t"), [("redo", ["A", "B"]), ("slow", ["B", "C"])])).collect()
    assert [r[0] for r in hints] == [["A", "B", "C"], []]


def test_timeline_is_short_and_sorted(spark):
    text = "\n".join(f"2024-01-{31 - k % 30:02d} 00:00:{k % 60:02d} ORA-00600 number {k}" for k in range(90))
    got = E.timeline(E.scan_lines(lines(spark, text)).withColumn("incident", F.lit(1))).orderBy("place").collect()
    assert len(got) == 40 and [r["timestamp"] for r in got] == sorted(r["timestamp"] for r in got)


def test_packages(spark, tmp_path):
    rows = [(k, json.dumps({"k": k}), "<p>", {"/a/x.trc": "trace"} if k else {}) for k in range(3)]
    df = spark.createDataFrame(rows, "incident long, findings string, html string, traces map<string,string>")
    got = E.write_packages(df, f"file://{tmp_path}/out").collect()
    assert sorted((r["incident"], r["n_files"]) for r in got) == [("0", 2), ("1", 3), ("2", 3)]
    with zipfile.ZipFile(tmp_path / "out" / "1.zip") as z:
        assert z.namelist() == ["findings.json", "report.html", "traces/x.trc"] and json.loads(z.read("findings.json")) == {"k": 1}
