"""The unified router: every parser whose gate a file passes, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.time import infer_years
from faultline.operators import parsers as P
from faultline.operators.core import dedupe_events
from faultline.operators.events import COLUMNS, conform
from faultline.sources.files import json_logs, report_text, stored

# fixed values: what a file's text has to show for a parser to run
GATES = {
    "syslog": r"(?i)kernel(?:\[\d+\])?:|multipathd(?:\[\d+\])?:|qla2xxx|lpfc|blk_update_request|DID_TIME_OUT|DRIVER_TIMEOUT|remaining\s+active\s+paths:\s*0|no\s+active\s+paths|rejecting\s+I/O\s+to\s+offline\s+device",
    "asm": r"(?i)Read Failed\.|cache dismounting|ORA-15\d{3}",
    "cell": r"(?i)CELLSRV|\bMS:|\bRS:|flashdisk|griddisk|celldisk",
    "crs": r"(?i)\bCRS-\d+\b|\[CSSD|\[CRSD|\bOHASD\b|\bEVMD\b",
    "errpt": r"(?m)^LABEL:\s+\w+",
    "osw": r"(?i)zzz\s+\*\*\*",
    "awr": r"(?i)AWR\s+Report|Workload\s+Repository|DB\s+Time.*\(mins\)|Top\s+\d+\s+Foreground\s+Events",
    "trace": r"(?im)Trace file|^\*\*\*.*SESSION ID:|Incident Id:",
    "audit": r"(?im)\bACTION\s*:\s+|\bRETURNCODE\s*:\s*\d|\bRETURNCODE\s*:\s*\[|^AUDIT|\bGRANT\s+DBA\b",
    "security": r"(?i)sshd|sudo|failed password|invalid user|authentication failure",
    "exawatcher": r"(?i)\bib\d+\b",
}
ORDER = (
    "alert_log_parser", "syslog_parser", "asm_snippet_parser", "cell_log_parser", "crs_parser", "aix_errpt_parser", "iostat_parser", "osw_parser", "awr_parser", "trace_parser",
    "audit_parser", "security_parser", "exawatcher_parser", "generic_evidence_parser",
)


def gates(text: Column) -> list[Column]:
    found = [text.rlike(p).alias(f"gate_{k}") for k, p in GATES.items()]
    head = F.substring(text, 1, 8000)
    return found + [(head.contains("Device") & head.contains("r_await") & head.contains("%util")).alias("gate_iostat")]


def _signals(rows: DataFrame, column: str, source: str, layer: str, kind: str, severity: str, parser: str, message: Column | None = None) -> DataFrame:
    out = rows.select("path", F.posexplode(column).alias("_k", "code"), *([message.alias("_message")] if message is not None else []))
    return conform(
        out.select(
            (F.col("_k") + 1).alias("line_number"), F.col("path").alias("source_path"), F.lit(source).alias("source_type"), F.lit(layer).alias("layer"), "code", F.lit(kind).alias("code_type"),
            (F.col("_message") if message is not None else F.col("code")).alias("message"), F.lit(severity).alias("severity"), F.lit("MEDIUM").alias("parse_confidence"),
            F.array(F.lit(source.upper())).alias("tags"), F.col("code").alias("raw"),
        ), parser)


def normalized_events(files: DataFrame, cell_name: str = "unknown", years: DataFrame | None = None) -> DataFrame:
    """Deduplicated normalized events of files (path, text).

    Gates are tested once a file and written with its text to the shared
    folder, so a parser reads only the files that pass its gate.
    The generic parser always runs, but for lines that gave an event already.
    Wrapped JSON logs count as files of their own.
    """
    # dealt before anything is tested, as a table of short texts comes in few splits
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = report_text(json_logs(files.select("path", "text").repartition(parts, "path")))
    texts = texts.select("path", "wrapper", F.explode(F.array("text")).alias("text")).where(F.coalesce(F.trim("text"), F.lit("")) != "")
    gated = stored(texts.select("path", "wrapper", "text", *gates(F.col("text"))), "routed")
    plain = P.lines_of(gated)
    years = stored(infer_years(plain), "years") if years is None else years
    of = lambda k: P.lines_of(gated.where(f"gate_{k}"))
    whole = lambda k: gated.where(f"gate_{k}").select("path", "text")
    path, tag = F.col("path").alias("source_path"), lambda t: F.array(F.lit(t)).alias("tags")
    iostat = P.parse_iostat(of("iostat"))
    code = F.when(F.col("util_pct") >= 95, "HIGH_DEVICE_UTILIZATION").when(F.col("await_ms") >= 100, "HIGH_AWAIT").otherwise("IOSTAT_DEVICE_ROW")
    errpt, audit, security, ib = P.parse_errpt(whole("errpt")), P.parse_audit(whole("audit")), P.parse_security(of("security")), P.parse_exawatcher(of("exawatcher"))
    kind = F.upper("event_type")
    trace_codes = of("trace").withColumn("code", F.explode(F.regexp_extract_all("line", F.lit(r"(?i)\b(ORA-\d{5})\b"))))
    parts = [
        P.alert_events(plain, years),
        P.syslog_events(P.parse_syslog(of("syslog"), years)),
        P.asm_events(of("asm")),
        P.cell_events(of("cell"), cell_name),
        P.crs_events(of("crs")),
        conform(errpt.select("line_number", "timestamp", "timestamp_raw", path, F.lit("aix_errpt").alias("source_type"), F.lit("OS").alias("layer"), F.coalesce("os_pattern", "label").alias("code"), F.lit("OS_PATTERN").alias("code_type"), F.coalesce("description", "raw").alias("message"), "severity", F.col("resource").alias("device"), F.col("hostname").alias("host"), F.lit("HIGH").alias("parse_confidence"), tag("AIX_ERRPT"), "raw"), "aix_errpt_parser"),
        conform(iostat.select("line_number", path, F.lit("iostat").alias("source_type"), F.lit("OS").alias("layer"), code.alias("code"), F.lit("GENERIC_PATTERN").alias("code_type"), "device", F.col("raw").alias("message"), "severity", tag("IOSTAT"), "raw"), "iostat_parser"),
        _signals(P.parse_osw(of("osw")), "osw_signals", "oswatcher", "OS", "GENERIC_PATTERN", "WARNING", "osw_parser"),
        _signals(P.parse_awr(whole("awr")), "awr_signals", "awr", "AWR", "AWR_PATTERN", "INFO", "awr_parser", F.array_join("wait_signals", ",")),
        conform(trace_codes.select("line_number", path, F.lit("trace").alias("source_type"), F.lit("DB").alias("layer"), F.upper("code").alias("code"), F.lit("ORA").alias("code_type"), F.trim("line").alias("message"), F.lit("ERROR").alias("severity"), tag("TRACE_SNIPPET"), F.trim("line").alias("raw")), "trace_parser"),
        conform(audit.select(F.lit(1).alias("line_number"), path, F.lit("audit_log").alias("source_type"), F.lit("AUDIT").alias("layer"), F.coalesce("event_type", F.when(F.coalesce("returncode", F.lit("0")) != "0", "AUTH_FAILURE").otherwise("AUDIT_EVENT")).alias("code"), F.lit("AUDIT_PATTERN").alias("code_type"), "severity", F.col("raw").alias("message"), tag("AUDIT"), "raw"), "audit_parser"),
        conform(security.select("line_number", path, F.lit("security_log").alias("source_type"), F.lit("SECURITY").alias("layer"), F.when(kind.contains("AUTH") | kind.contains("FAILED"), "AUTH_FAILURE").when(kind.contains("SUDO") | kind.contains("PRIVILEGE"), "PRIVILEGE_CHANGE").otherwise("SECURITY_POLICY_EVENT").alias("code"), F.lit("SECURITY_PATTERN").alias("code_type"), "severity", F.col("details").alias("message"), tag("SECURITY"), "raw"), "security_parser"),
        conform(ib.select("line_number", path, F.lit("exawatcher").alias("source_type"), F.lit("STORAGE").alias("layer"), F.lit("EXAWATCHER_IB_LINK_ISSUE").alias("code"), F.lit("STORAGE_PATTERN").alias("code_type"), "severity", "message", F.col("hostname").alias("host"), "component", tag("EXAWATCHER"), "raw"), "exawatcher_parser"),
    ]
    known = reduce(lambda a, b: a.unionByName(b), parts)
    # a line that gave another event is none of the generic parser's; one pass
    # over the union, so the other parsers' plans run once
    same = Window.partitionBy("source_path", F.trim("raw"))
    own = F.col("parser_name") != "generic_evidence_parser"
    every = known.unionByName(P.generic_events(plain)).withColumn("_own", own).withColumn("_taken", F.max(own).over(same)).where("_own or not _taken").drop("_own", "_taken")
    rank = F.array_position(F.array(*[F.lit(p) for p in ORDER]), F.col("parser_name"))
    out = dedupe_events(every.withColumn("_rank", rank), ["line_number", "_rank", "event_id"]).drop("_rank")
    wrapped = gated.where("wrapper is not null").select(F.col("path").alias("source_path"), "wrapper").dropDuplicates(["source_path"])
    out = out.join(wrapped, "source_path", "left")
    details = F.when(F.col("wrapper").isNotNull(), F.map_concat("details", F.create_map(F.lit("wrapper_source"), "wrapper"))).otherwise(F.col("details"))
    return out.withColumn("details", details).select(*COLUMNS)
