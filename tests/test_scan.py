import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import correlation, parsers, scan

LINES = [
    "Mar  7 02:44:18 db1 kernel: disk error", "  more of it", "", "Thu Mar 07 02:44:18 2024", "Errors in file /u01/trace/a.trc:", "ORA-27072: File I/O error", "Linux-x86_64 Error: 5: Input/output error",
    "Current SQL statement for this session:", "select 1", "name: disk1", "size: 10", "Device: rrqm/s wrqm/s r/s w/s avgrq-sz await svctm %util", "sdb 0 0 1 2 3 4 5 6 7 8 9 10", "LGWR: terminating the instance due to error 472",
    "----- Call Stack Trace -----", "ksedst()", "ORA-15130: diskgroup", "2024-03-07T02:44:18.123456+05:30", "celldisk: FD_00",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    files = [(f"f{i}", "\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [("none", "")]
    return spark.createDataFrame(files, "path string, text string")


def collected(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "parse",
    [
        parsers.parse_syslog, parsers.truncate_dumps, parsers.parse_alert_blocks, parsers.alert_events, parsers.parse_records, parsers.parse_iostat, parsers.parse_trace,
        lambda lines: parsers.blocks(lines, F.col("line").startswith("ORA"), keep_head=True),
    ],
)
def test_slices_don_t_show(spark, texts, monkeypatch, parse):
    lines = parsers.lines_of(texts)
    whole = collected(parse(lines))
    monkeypatch.setattr(scan, "SLICE", 7)
    sliced = collected(parse(lines.drop("n_lines")))
    assert sorted(re.sub(r", n_lines=\d+", "", r) for r in whole) == sliced


def test_scan_is_the_window_over_the_whole_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    got = scan.scan(df, ["k"], ["i"], F.floor(F.col("i") / 9), {"seen": F.col("v")}, {"n": F.col("v")})
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("seen", F.last("v", ignorenulls=True).over(w)).withColumn("n", F.sum("v").over(w))
    assert collected(got.select(*want.columns)) == collected(want)
    assert not scan.scan(df.limit(0), ["k"], ["i"], F.col("i"), {"seen": F.col("v")}).count()


def test_no_window_holds_a_file(spark, texts):
    plan = parsers.parse_alert_blocks(parsers.lines_of(texts).drop("n_lines"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # but for the one over a file's borders, every window is within a slice
    assert windows and all("_slice" in w and ("_end_" in w or "_slice#" in w.split("], [")[1]) for w in windows)


def test_carried_over_hours_and_without_a_time(spark):
    rows = [("u", None, 1, "x"), ("u", "2024-01-01 00:10:00", 2, None), ("u", "2024-01-01 05:00:00", 3, "y"), ("u", "2024-01-02 00:00:00", 4, None), ("v", "2024-01-01 00:00:00", 5, None)]
    df = spark.createDataFrame(rows, "k string, at string, i int, v string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = correlation.carried(df, ["k"], ["at", "i"], "v", "last").orderBy("i").collect()
    assert [r["last"] for r in got] == ["x", "x", "y", "y", None]


def test_lines_of_a_file_read_in_splits(spark, tmp_path):
    rng = random.Random(9)
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"line {i} {'x' * rng.randrange(90)}\n" for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        from faultline.sources.files import numbered_lines

        got = numbered_lines(spark, f"file://{tmp_path}").select("path", "line_number", F.split("line", " ")[1].cast("int").alias("i")).collect()
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1400 and all(r.line_number == r.i + 1 for r in got)


def test_logs_of_hosts_are_written_into_one_folder(spark, tmp_path):
    import glob
    import os

    from faultline.plans import catalog

    rows = [(3, 1, "error", "c"), (1, 1, "view", "a"), (2, 1, "error", "b"), (5, 2, "click", "z"), (6, 2, "error", "e"), (4, 3, "view", "d")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/logs-*"))
    got = sorted(tuple(r) for r in catalog.queries()["split_file_blocks"](spark, str(tmp_path)).collect())
    assert got == [("host1", 2, "b", 1), ("host1", 3, "c", 2), ("host2", 2, "e", 1)]
    (folder,) = set(glob.glob(f"{root}/logs-*")) - before
    assert sorted(os.listdir(folder)) == ["host1.log", "host2.log", "host3.log"]  # were folders that the driver lists one by one
