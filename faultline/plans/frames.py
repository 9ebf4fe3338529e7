"""The driver's tables seen as the engine's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of a task, where their number has to bound its memory
TASK_ROWS = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows dealt by keys to as many tasks as hold TASK_ROWS each, the
    session's number at least.  Adaptive execution joins tasks by the bytes
    they read, and these may take twenty times as much in memory."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // TASK_ROWS)), *keys)


def chunks_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks: users are hosts, event types are sources; purchases
    and signups stand for infrastructure."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("chunk_id"), F.concat(F.lit("host"), "user_id").alias("hostname"), kind.alias("log_source"), F.col("ts").alias("timestamp_start"),
        F.when(kind.isin("purchase", "signup"), "DISK").when(kind == "error", "ORACLE").otherwise("APP").alias("category"),
        F.when(F.col("value") > 100, "CRITICAL").when(F.col("value") > 5, "ERROR").otherwise("INFO").alias("severity"),
        F.when(kind == "error", F.when(F.col("user_id") % 7 == 0, "ORA-00942").otherwise("ORA-27072")).otherwise("").alias("ora_code"),
        F.when(kind == "purchase", "SCSI_DISK_TIMEOUT").when(kind == "signup", "FC_HBA_RESET").otherwise("").alias("os_pattern"), F.col("value"), F.col("user_id"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT event_id AS chunk_id, 'host' || user_id AS hostname, event_type AS log_source, ts AS timestamp_start,
    CASE WHEN event_type IN ('purchase','signup') THEN 'DISK' WHEN event_type = 'error' THEN 'ORACLE' ELSE 'APP' END AS category,
    CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 5 THEN 'ERROR' ELSE 'INFO' END AS severity,
    CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 7 = 0 THEN 'ORA-00942' ELSE 'ORA-27072' END ELSE '' END AS ora_code,
    CASE event_type WHEN 'purchase' THEN 'SCSI_DISK_TIMEOUT' WHEN 'signup' THEN 'FC_HBA_RESET' ELSE '' END AS os_pattern, value, user_id
  FROM events)"""


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of a cluster: users that are customers of a nation's region."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("cluster"), "n_nationkey").alias("cluster_name"), F.concat(F.lit("HOST"), "c_custkey").alias("host"))


TOPOLOGY_SQL = """topology AS (
  SELECT 'cluster' || n_nationkey AS cluster_name, 'HOST' || c_custkey AS host FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
