"""Sessions of several turns, and the evidence store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.core import first_wins, numbered_runs

# fixed values
BOUNDARY = "\n\n"
PINNED = r"(?i)\bORA-\d{5}\b|\bCRS-\d+\b|\bTNS-\d+\b|terminating the instance|\b(FLASH_IO_TIMEOUT|SCSI_DISK_TIMEOUT|MULTIPATH|FC_HBA_RESET)\b"
HEAD_SHARE, MOST_PINS = 0.45, 220
STORE_TABLES = (
    "incident_case", "source_bundle", "source_file", "parser_run", "pattern_catalog", "normalized_event", "event_pattern_match", "correlation_run", "event_correlation_edge",
    "rca_candidate", "cascade_step", "report_snapshot", "recommended_action", "human_feedback",
)
RENAMED = {"timestamp": "ts", "database": "database_name", "instance": "instance_name", "offset": "offset_value", "block": "block_value", "size": "size_value"}


def pinned_lines(turns: DataFrame, most: int = MOST_PINS) -> DataFrame:
    """Telling lines of a session's turns, each once without case, in
    order, up to a limit; a code's first line is always telling."""
    lines = turns.where("kind <> 'zip'").select("session_id", "turn", "label", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(PINNED))
    once = first_wins(lines, ["session_id", F.lower("line")], ["turn", "pos"])
    place = Window.partitionBy("session_id").orderBy("turn", "pos")
    text = F.concat(F.lit("[turn "), (F.col("turn") + 1).cast("string"), F.lit(":"), F.coalesce("label", F.lit("")), F.lit("] "), "line")
    return once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("session_id", "place", text.alias("pin"))


def merged(turns: DataFrame, most: int = 0) -> DataFrame:
    """One text a session: turns with headers in order.  Beyond ``most``
    characters its head, pinned lines and its tail stay."""
    body = F.concat(F.lit("# turn "), (F.col("turn") + 1).cast("string"), F.lit(" kind="), "kind", F.lit(" label="), F.coalesce(F.nullif("label", F.lit("")), "kind"), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = turns.where("kind <> 'zip'").withColumn("body", body)
    whole = rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), BOUNDARY).alias("text"))
    if most <= 0:
        return whole
    pins = pinned_lines(turns).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "pin"))), lambda x: F.concat(F.lit("- "), x["pin"])), "\n").alias("pins"))
    both = whole.join(pins, "session_id", "left").withColumn("pins", F.coalesce("pins", F.lit("")))
    budget = F.greatest(F.lit(0), F.lit(most) - F.length("pins") - 64)
    head = F.floor(budget * HEAD_SHARE).cast("int")
    cut = F.concat_ws("\n", F.substring("text", F.lit(1), head), F.lit("# [size cap: head, pinned signals, tail]"), "pins", F.expr(f"right(text, greatest(0, {most} - length(pins) - 64) - cast(floor(greatest(0, {most} - length(pins) - 64) * {HEAD_SHARE}) as int))"))
    return both.select("session_id", F.when(F.length("text") > most, cut).otherwise(F.col("text")).alias("text"))


def memory(events: DataFrame, key: str = "session_id", codes: int = 25, patterns: int = 20) -> DataFrame:
    """A4: what a session has seen: sorted sets, and the most frequent codes
    and patterns.  Codes are also found in messages."""
    code = F.upper(F.trim(F.coalesce("code", F.lit(""))))
    found = F.transform(F.regexp_extract_all(F.concat_ws("\n", "message", "raw"), F.lit(r"(?i)\b(ORA-\d{5})\b")), F.upper)
    rows = events.withColumn("_code", code).withColumn("_oras", F.when(code.rlike(r"^ORA-\d{5}$"), F.array(code)).otherwise(found))
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    sets = rows.groupBy(key).agg(names("layer").alias("layers"), names("host").alias("hosts"), names("device").alias("devices"), names("diskgroup").alias("diskgroups"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_oras")))).alias("ora_codes"))
    ranked = lambda df, name: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias(name))
    own = F.upper(F.coalesce("code_type", F.lit(""))).contains("PATTERN") if "code_type" in events.columns else ~code.rlike(r"^ORA-\d{5}$")
    top = ranked(code_counts(events, [key], codes), "signal_codes").join(ranked(code_counts(events.where(own), [key], patterns), "top_patterns"), key, "full_outer")
    return sets.join(top, key, "left")


def code_counts(events: DataFrame, keys: list[str], k: int) -> DataFrame:
    """A5: the k most frequent codes of each key, but for generic ones."""
    counted = events.withColumn("code", F.upper("code")).where((F.col("code") != "") & ~F.col("code").startswith("GENERIC_")).groupBy(*keys, "code").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "code")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_shares(counts: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """(keys, code, score): a code's share plus 0.4, 0.95 at most, to two
    digits of the binary value (``round`` would take its decimal spelling)."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "code")
    scored = counts.withColumn("score", F.floor(F.least(F.lit(0.95), F.col("n") / F.greatest(total, F.lit(1)) + 0.4) * 100 + 0.5) / 100)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "code", "n", "score")


def stored_events(events: DataFrame, run: Column) -> DataFrame:
    """K2: events as the store names their columns; what it has no column for
    goes into details."""
    out = events.withColumn("details", F.map_concat("details", F.map_filter(F.create_map(F.lit("mapped_code_hint"), "mapped_code_hint", F.lit("parser_name"), "parser_name", F.lit("source_type"), "source_type"), lambda k, v: v.isNotNull())))
    for old, new in RENAMED.items():
        out = out.withColumnRenamed(old, new)
    return out.withColumn("parser_run_id", run).withColumn("raw_hash", F.substring(F.sha2(F.col("raw").cast("binary"), 256), 1, 32)).withColumn("details", F.to_json("details")).drop("mapped_code_hint", "parser_name", "source_type")


def write_run(folder: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """K2: all tables of a run, then its manifest: a run without a manifest
    doesn't count, so a broken write leaves nothing that is read."""
    unknown = set(tables) - set(STORE_TABLES)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")
    spark.createDataFrame([(run_id, sorted(tables))], "run string, tables array<string>").write.mode("overwrite").parquet(f"{folder}/_manifest/run_id={run_id}")


def read_store(spark, folder: str, name: str) -> DataFrame:
    """K2: rows of finished runs only."""
    done = spark.read.parquet(f"{folder}/_manifest").select(F.col("run_id").cast("string").alias("run_id")).distinct()
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(done, "run_id", "left_semi")


def diagnosis_tables(analysis: DataFrame, events: DataFrame, run_id: str, earlier_runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """K2-K4: the tables that a diagnosis of incidents writes."""
    cases = analysis.select(F.col("incident").alias("incident_id"), "status", "root_cause", "root_layer", F.col("score").alias("correlation_score"))
    runs = numbered_runs(analysis.select(F.col("incident").alias("incident_id"), F.lit(run_id).alias("correlation_run_id")), earlier_runs, "incident_id", ["correlation_run_id"])
    candidates = analysis.select(F.col("incident").alias("incident_id"), F.lit(run_id).alias("correlation_run_id"), "root_cause", "root_layer", "score", F.lit(True).alias("is_selected"))
    order = Window.partitionBy("incident").orderBy("_depth", "code")
    from faultline.operators.reasoning import cascade_order

    steps = events.where(F.col("code").isNotNull()).select("incident", "code", "layer").distinct().withColumn("_depth", cascade_order(F.col("code")))
    steps = steps.withColumn("step", F.row_number().over(order)).select(F.col("incident").alias("incident_id"), "step", "code", "layer")
    files = events.groupBy(F.col("incident").alias("incident_id"), F.col("source_path").alias("path")).agg(F.count("*").alias("n_events"))
    parsers = events.groupBy(F.col("incident").alias("incident_id"), "parser_name").agg(F.count("*").alias("n_events"))
    return {
        "incident_case": cases, "source_file": files, "parser_run": parsers, "normalized_event": stored_events(events, F.lit(run_id)), "correlation_run": runs,
        "rca_candidate": candidates, "cascade_step": steps, "report_snapshot": analysis.select(F.col("incident").alias("incident_id"), F.to_json(F.struct(*analysis.columns)).alias("report")),
    }


def learned(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """K9: validated new incidents appended to the chunks that lack them."""
    category = F.when(F.col("category").isin("OS", "DISK", "MEMORY", "NETWORK", "CRS", "ORACLE", "SECURITY", "HARDWARE"), F.col("category")).otherwise("ORACLE")
    severity = F.when(F.col("severity").isin("CRITICAL", "ERROR", "WARNING", "INFO"), F.col("severity")).otherwise("ERROR")
    valid = new.withColumn("category", category).withColumn("severity", severity).dropDuplicates(["chunk_id"])
    return chunks.unionByName(valid.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), allowMissingColumns=True)
