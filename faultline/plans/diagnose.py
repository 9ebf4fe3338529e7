"""Whole pipelines: retrieval and diagnosis, many queries or incidents a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import DEFAULT, Settings
from faultline.functions.time import group
from faultline.operators import correlation, patterns, reasoning, retrieval
from faultline.plans.ingest import normalized_events
from faultline.sources.files import stored

# fixed values
SYSLOG_START = r"(?m)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
PASTE = (
    r"(?m)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", r"(?m)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2}", r"(?m)^\[\s*[\d.]+\]",
    r"(?m)^LABEL:\s+\w+", r"(?i)alertType:|cellDiskType:", r"(?i)Event ID:\s*\d+|Source:\s+\w+", r"kernel:",
)
PLATFORM_HINTS = (
    (r"(?m)LABEL:\s+\w+\nIDENTIFIER:", "AIX"), (r"(?i)Linux-x86_64(?:\s+Error:)?|Linux\s+x86_64|Linux\s+aarch64|TNS\s*:\s*for\s+Linux|TNS\s+for\s+Linux", "LINUX"), (r"(?i)IBM AIX RISC", "AIX"),
    (r"(?i)SunOS-\d+\.\d+ Error:|fmadm", "SOLARIS"), (r"(?i)O/S-Error: \(OS \d+\)", "WINDOWS"), (r"(?i)cellDiskType:|cellcli", "EXADATA"), (r"(?i)cloud-agent|oci-metadata", "OCI"),
    (r"(?i)vCenter|esx", "VMWARE"), (r"(?i)\bAWS\b|\bec2\b|\brds\b", "AWS"),
)
UNAME = ((r"(?i)Linux.*x86_64|Oracle Linux|Red Hat|CentOS", "LINUX"), (r"(?i)AIX|IBM AIX", "AIX"), (r"(?i)SunOS|Solaris", "SOLARIS"), (r"(?i)HP-UX", "HPUX"), (r"(?i)CYGWIN|Windows", "WINDOWS"))
ERRNO_LINES = ((r"Linux-x86_64 Error:", "LINUX"), (r"IBM AIX RISC System", "AIX"), (r"SunOS-\d+\.\d+ Error:|Solaris", "SOLARIS"), (r"HP-UX Error:", "HPUX"), (r"O/S-Error: \(OS \d+\)", "WINDOWS"))
CONTENT = (
    (r"(?m)^LABEL:\s+\w+\s*\nIDENTIFIER:", "AIX"), (r"(?i)fmadm.*faultid|fmadm.*repaired", "SOLARIS"), (r"(?i)fmdump.*UUID:|fault\.io\.scsi", "SOLARIS"),
    (r"(?i)/var/adm/syslog|HP-UX B\.\d+\.\d+", "HPUX"), (r"(?i)Event ID:\s+\d+|Level:\s+Error\s*\nDate:", "WINDOWS"),
    (r"(?i)cellcli.*alerthistory|alertType:.*Stateful|cellDiskType:|Read Failed. group:\d+", "EXADATA"), (r"(?i)cloud-agent|oracle-cloud-agent|oci-metadata", "OCI"),
)
FILE_NAMES = (
    (r"(?i)errpt", "AIX"), (r"(?i)lspath|lparstat|fcstat", "AIX"), (r"(?i)fmdump|fmadm|var_adm_messages", "SOLARIS"), (r"(?i)eventvwr|event_viewer|evtx", "WINDOWS"),
    (r"(?i)cellcli|exadata", "EXADATA"), (r"(?i)var_log_messages|messages$|dmesg|syslog", "LINUX"), (r"(?i)alert.*oci|oci.*alert|cloud.agent", "OCI"),
)
ERRNO = {
    "LINUX": r"Linux-x86_64 Error: (\d+): (.+)", "AIX": r"IBM AIX RISC System/6000 Error: (\d+): (.+)", "SOLARIS": r"Solaris-\w+ Error: (\d+): (.+)", "HPUX": r"HP-UX Error: (\d+): (.+)",
    "WINDOWS": r"O/S-Error: \(OS (\d+)\) (.+)",
}
OBSERVED = {
    "DB": ("ORA-", "ERRORS IN FILE", "LGWR", "PMON"), "OS": ("KERNEL:", "DMESG", "BLK_UPDATE_REQUEST", "MULTIPATHD"), "INFRA": ("CELLSRV", "EXAWATCHER", "IORM", "CELLCLI"),
    "STORAGE": ("FLASH_IO_TIMEOUT", "FLASHDISK", "GRIDDISK", "CELLDISK"), "RDBMS": ("TRACE/", ".TRC", "CALL STACK"),
}
COMMAND_STARTS = (
    "SELECT ", "WITH ", "ALTER ", "CREATE ", "DROP ", "GRANT ", "REVOKE ", "EXEC ", "EXECUTE ", "BEGIN ", "DECLARE ", "CALL ", "RMAN", "SQLPLUS", "CRSCTL ", "ASMCMD ", "ADRCI ",
    "SRVCTL ", "ODACLI", "KFOD ", "KFED ", "EXPDP ", "IMPDP ", "LISTENERCTL", "LSNRCTL",
)


def _first(text: Column, table) -> Column:
    out = F.when(F.lit(False), "")
    for regex, name in table:
        out = out.when(text.rlike(regex), name)
    return out


def platform(text: Column, filename: Column | None = None, uname: Column | None = None) -> Column:
    """Uname first, then error lines, content and file name."""
    parts = [] if uname is None else [_first(uname, UNAME)]
    parts += [_first(text, ERRNO_LINES), _first(text, CONTENT)]
    parts += [] if filename is None else [_first(filename, FILE_NAMES)]
    return F.coalesce(*parts, F.lit("UNKNOWN"))


def errno(text: Column, platform_name: Column | None = None) -> Column:
    """struct(number, message) of the platform's error line, of any
    platform's if it has no form of its own; null if there is none."""
    each = {p: F.when(text.rlike(r), F.struct(F.regexp_extract(text, r, 1).alias("number"), F.regexp_extract(text, r, 2).alias("message"))) for p, r in ERRNO.items()}
    any_ = F.coalesce(*each.values())
    if platform_name is None:
        return any_
    out = F.when(F.lit(False), any_)
    for p, c in each.items():
        out = out.when(platform_name == p, c)
    return F.when(platform_name.isin(*each), out).otherwise(any_)


def parse_input(queries: DataFrame) -> DataFrame:
    """Mode, codes, host, time, platform and layers of queries (query_id,
    text)."""
    t = F.regexp_replace(F.trim("text"), r"\r\n?", "\n")
    codes = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)(ORA-\d{5})")), F.upper))
    paste = F.lit(False)
    for p in (SYSLOG_START, *PASTE):
        paste = paste | t.rlike(p)
    mode = F.when(t.rlike(r"(?i)^ORA-\d{5}"), "ora_code").when(paste | (t.contains("ORA-") & t.contains("\n")), "log_paste").otherwise("natural_language")
    up = F.upper(t)
    observed = F.array_compact(F.array(*[F.when(_any(up, words), layer) for layer, words in sorted(OBSERVED.items())]))
    host = F.coalesce(group(t, r"(?i)on\s+(\S+host\S*|\w+\d+\w*)"), group(t, SYSLOG_START + r"\s+(\S+)", 2))
    iso = group(t, r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?|\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})\b")
    return queries.select(
        "query_id", mode.alias("mode"), t.alias("query"), F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("")).alias("primary_ora"), codes.alias("ora_codes"),
        F.coalesce(host, F.lit("")).alias("hostname"), F.coalesce(iso, group(t, SYSLOG_START, 0), F.lit("")).alias("timestamp_str"), F.coalesce(_first(t, PLATFORM_HINTS), F.lit("UNKNOWN")).alias("platform"),
        observed.alias("observed_layers"),
    )


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def executable_command(text: Column) -> Column:
    """Whether a line is something to run rather than prose."""
    u = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    first = F.trim(F.substring_index(u, "\n", 1))
    starts = F.lit(False)
    for p in COMMAND_STARTS:
        starts = starts | first.startswith(p)
    statement = first.contains(";") & first.rlike("SELECT|ALTER|INSERT|UPDATE|DELETE")
    prose = (u == "") | (F.length(u) > 8000) | (u.contains("CAUSE:") & u.contains("ACTION:"))
    return ~prose & (starts | statement | first.startswith("$") | first.startswith("ORAPWD"))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, topology: DataFrame | None = None, cascades: DataFrame | None = None, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Fused hits of queries (query_id, text, query_embedding) with payload,
    their correlated chunks, bonuses and cascades.

    Keyword statistics are those of the whole corpus.  Hits of either list get
    their payload from the chunks, so each can be correlated.
    """
    keyword = retrieval.bm25_topk(queries, chunks.select("chunk_id", F.col("raw_text").alias("text")), settings.top_k * 2, settings)
    vector = retrieval.dense_topk(queries.select("query_id", "query_embedding"), vectors, settings.top_k * 2)
    fused = retrieval.fuse(keyword, vector, settings).join(chunks, "chunk_id", "left")
    reference = fused.select(*chunks.columns).dropDuplicates(["chunk_id"])
    linked = correlation.temporal_correlation(reference, chunks, topology, settings)
    out = {"fused": fused, "correlated": linked, "bonuses": correlation.temporal_bonus(reference, chunks, topology, settings)}
    if cascades is not None:
        items = lambda df: df.select("query_id", F.explode(F.array("os_pattern", "ora_code")).alias("item")).where("item <> ''")
        near = fused.select("query_id", "chunk_id").join(linked.select("chunk_id", F.col("correlated_id").alias("_id")), "chunk_id").join(chunks.withColumnRenamed("chunk_id", "_id"), "_id")
        out["cascades"] = correlation.cascades(items(fused).unionByName(items(near)), cascades, "query_id")
    return out


def diagnose(files: DataFrame, rules: dict | None = None, benign: list[str] = ()) -> dict[str, DataFrame]:
    """Live path: files (incident, path, text) to events, patterns, analysis and
    gated reports, one row an incident."""
    events = normalized_events(files.select("path", "text")).join(files.select("incident", F.col("path").alias("source_path")).dropDuplicates(), "source_path", "left")
    events = stored(events, "events")  # read by the analysis, the reports and the caller
    analysis = reasoning.analyse(events)
    matched = None
    if rules:
        hits = patterns.match(files.select(F.col("path").alias("chunk_id"), F.col("text").alias("raw_text")), rules, benign, source=None)
        matched = hits.join(files.select("incident", F.col("path").alias("chunk_id")), "chunk_id").groupBy("incident").agg(F.array_sort(F.collect_set("pattern_id")).alias("matched"))
    base = analysis.join(matched, "incident", "left") if matched is not None else analysis.withColumn("matched", F.lit(None).cast("array<string>"))
    strong = (F.col("score") >= 85) & F.col("status").isin("CONFIRMED", "LIKELY")
    label = F.when(strong & (F.col("status") == "CONFIRMED"), "HIGH").when(strong, "MEDIUM").when(F.col("score") >= 50, "LOW").otherwise("NO_MATCH")
    report = base.select(
        "incident", F.lit("log_paste").alias("mode"), F.coalesce(F.try_element_at("oras", F.lit(1)), F.lit("")).alias("primary_ora"), "layers", "oras",
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), F.when(F.col("score") >= 50, F.col("root_cause")).alias("best_pattern"), F.col("score").alias("best_score"),
        label.alias("best_label"), F.size("layers").alias("n_sources"), F.col("status").alias("rca_status"), F.col("score").alias("rca_score"), F.lit(False).alias("has_chain"), "root_cause", "root_layer",
    )
    return {"events": events, "analysis": analysis, "report": reasoning.downgrade(reasoning.report_gate(report))}


