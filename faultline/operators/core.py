"""Filters, keyed writes, dedupe and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import DEFAULT


def prefilter(
    chunks: DataFrame, hostname=None, timestamp=None, severities=None, platform=None, code=None, minutes: int = DEFAULT.prefilter_window_minutes,
    limit: int = DEFAULT.prefilter_limit, fail_open: bool = True,
) -> DataFrame:
    """the conjunction of the conditions given, earliest first.  With
    no condition nothing is restricted (``fail_open``) or nothing is kept."""
    conditions: list[Column] = []
    for column, value in (("hostname", hostname), ("platform", platform), ("ora_code", code)):
        if value is not None:
            conditions.append(F.col(column) == value)
    if severities:
        conditions.append(F.col("severity").isin(list(severities)))
    if timestamp is not None:
        at = F.lit(timestamp).cast("timestamp_ntz")
        gap = F.expr(f"INTERVAL {minutes} MINUTES")
        conditions.append(F.col("timestamp_start").between(at - gap, at + gap))
    if not conditions:
        return chunks if fail_open else chunks.limit(0)
    return chunks.where(reduce(lambda a, b: a & b, conditions)).orderBy("timestamp_start", "chunk_id").limit(limit)


def first_wins(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in the given total order.  Keys are
    compared as they are given; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def dedupe_events(events: DataFrame, order: list[Column | str]) -> DataFrame:
    """First by (path or file, line, code, start of raw), then vendor codes
    once a line."""
    path = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.col("source_file"), F.lit(""))
    line = F.coalesce("line_number", F.lit(0))
    code = F.upper(F.coalesce("code", F.lit("")))
    once = first_wins(events, [path, line, code, F.substring(F.coalesce("raw", F.lit("")), 1, 200)], order)
    vendor = F.trim(F.coalesce("code", F.lit(""))).rlike(r"(?i)^ORA-\d{5}")
    rank = F.row_number().over(Window.partitionBy(path, line, F.upper(F.trim("code")), vendor).orderBy(*order))
    return once.withColumn("_place", F.when(vendor, rank).otherwise(1)).where("_place = 1").drop("_place")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """K3: rows of the union with the latest version of each key.  ``version``
    has to tell rows of a key apart for the result to be one and the same."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    return first_wins(both, keys, [F.desc(version)])


def insert_new(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one a key."""
    return incoming.join(current.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def numbered_runs(runs: DataFrame, stored: DataFrame | None, key: str, order: list) -> DataFrame:
    """K4: run numbers go on from the highest stored one of the key."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if stored is None:
        return runs.withColumn("run_number", number)
    top = stored.groupBy(key).agg(F.max("run_number").alias("_top"))
    return runs.withColumn("run_number", number).join(top, key, "left").withColumn("run_number", F.col("run_number") + F.coalesce("_top", F.lit(0))).drop("_top")


def top_per_key(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """T*/A5: the first k rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def pick_best(candidates: DataFrame, key: str, close: float = 5.0) -> DataFrame:
    """T5: the best score, or the second if it is within ``close`` and critical
    while the first isn't."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "candidate_id")
    ranked = candidates.withColumn("_rank", F.row_number().over(w)).where("_rank <= 2")
    ranked = ranked.withColumn("_next", F.lead(F.struct("score", "severity")).over(w)).withColumn("_before", F.lag(F.struct("score", "severity")).over(w))
    swap = lambda first, first_sev, second, second_sev: (first - second < close) & (second_sev == "CRITICAL") & (first_sev != "CRITICAL")
    stays = (F.col("_rank") == 1) & ~F.coalesce(swap(F.col("score"), F.col("severity"), F.col("_next.score"), F.col("_next.severity")), F.lit(False))
    comes = (F.col("_rank") == 2) & F.coalesce(swap(F.col("_before.score"), F.col("_before.severity"), F.col("score"), F.col("severity")), F.lit(False))
    return ranked.where(stays | comes).drop("_rank", "_next", "_before")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """(relation, missing keys, rows) that a foreign key doesn't find."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return lost.agg(F.lit(name).alias("relation"), F.count_distinct(child_key).alias("missing_keys"), F.count("*").alias("orphan_rows"))
