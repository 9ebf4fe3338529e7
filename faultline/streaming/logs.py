"""Log lines as a stream: parsing, windows, storms and near correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import DEFAULT
from faultline.functions.text import message_severity
from faultline.operators.parsers import syslog_fields


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def syslog_stream(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Entries of single lines with severity; others are left out."""
    parsed = lines.withColumn("f", syslog_fields(F.col("line"), F.lit(year).cast("int"))).where("f is not null")
    return parsed.select("path", "f.*", F.col("line").alias("raw")).withColumn("severity", message_severity(F.col("message")))


def host_windows(entries: DataFrame, window_sec: int = DEFAULT.time_window_sec, late: str = "10 minutes") -> DataFrame:
    """Entries of each host and window by severity; the watermark bounds
    the state."""
    timed = entries.where("timestamp is not null").withWatermark("timestamp", late)
    return timed.groupBy(F.window("timestamp", f"{window_sec} seconds"), "host", "severity").count()


def storm_sessions(entries: DataFrame, gap_sec: int = DEFAULT.storm_gap_sec, late: str = "10 minutes") -> DataFrame:
    """A session goes on while gaps stay under ``gap_sec`` (and a
    microsecond, as an equal gap still belongs to it)."""
    timed = entries.where("timestamp is not null").withWatermark("timestamp", late)
    sessions = timed.groupBy(F.session_window("timestamp", f"{gap_sec} seconds 1 microsecond"), "host", "process").agg(F.count("*").alias("occurrences"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return sessions.select("host", "process", "first_seen", "last_seen", "occurrences")


def near_errors(reference: DataFrame, others: DataFrame, window_sec: int = DEFAULT.time_window_sec, late: str = "10 minutes") -> DataFrame:
    """J1's near leg on streams (id, host, source, timestamp): an interval join
    whose state both watermarks bound."""
    a = reference.withWatermark("timestamp", late).select(F.col("id").alias("a_id"), F.col("host").alias("a_host"), F.col("source").alias("a_source"), F.col("timestamp").alias("a_ts"))
    b = others.withWatermark("timestamp", late).select(F.col("id").alias("b_id"), F.col("host").alias("b_host"), F.col("source").alias("b_source"), F.col("timestamp").alias("b_ts"))
    span = F.expr(f"INTERVAL {window_sec} SECONDS")
    on = (F.col("a_host") == F.col("b_host")) & (F.col("b_ts") >= F.col("a_ts") - span) & (F.col("b_ts") <= F.col("a_ts") + span) & (F.col("a_source") != F.col("b_source"))
    return a.join(b, on).select("a_id", "b_id", "a_host", "a_ts", "b_ts")
