"""Correlation evidence: events from lines, and the tables of a root-cause
report.  Every function takes many incidents (or files) at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.time import group
from faultline.operators.core import first_wins
from faultline.operators.reasoning import OS_PATH_PATTERNS, cascade_order, category_layer, deepest_pattern, has, normal_layer, pattern_layer

# fixed values -----------------------------------------------------------------
CELL_SIGNATURE = r"(?i)FLASH_IO_TIMEOUT|flashdisk|celldisk|griddisk|CELLSRV|cellcli"
LGWR_TERMINATION = r"(?i)LGWR.*terminating.*instance"
LINE_LAYERS = (
    ("STORAGE", rf"{CELL_SIGNATURE}|MEDIA READ RETRIES"),
    ("ASM", r"(?i)ASM|DISKGROUP|ORA-15[01]|(?-i:\+DATA)"),
    ("DB", rf"{LGWR_TERMINATION}|ORA-|ERRORS IN FILE"),
    ("OS", r"(?i)KERNEL:|DMESG|MULTIPATHD|QLA2XXX|LPFC|BLK_UPDATE_REQUEST|I/O ERROR|SCSI"),
    ("NETWORK", r"(?i)TNS-|LISTENER"),
    ("BACKUP", r"(?i)RMAN|BACKUP"),
)
LINE_TIMES = (
    r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\b", r"^((?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\w+\s+\d{1,2}\s+[\d:]+)",
    r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
)
PROCESSES = ("LGWR", "DBWR", "CKPT", "ARC", "PMON", "SMON", "MMON", "ASMB", "LMD", "LMON", "LMS")
LINE_TRACE = r"(/[\w./]+\.(?:trc|TRC))\b"
LINE_DEVICE = r"(?i)\b(sd[a-z]+)\b|(?:dev|mpath)(/[\w/]+)|\b(mpath[a-z0-9_]+)\b"
LINE_DISKGROUP = r"(?i)diskgroup\s+['\"]?(\w+)['\"]?|\+(\w+)\b"
LINE_READ_FAILED = r"(?i)Read Failed.*?group[:\s]*(\d+).*?AU[:\s]*(\d+).*?offset[:\s]*(\d+)"
LINE_ERRNO = r"(?i)Linux[-\w]*\s+Error:\s*\(?(\d+)\)?|O/S-Error:\s*\(OS\s*(\d+)\)|errno=(\d+)"
ORA_CATALOG = {
    "ORA-27072": ("DB_IO_SYMPTOM", "Oracle file I/O error — bridge from OS/storage to RDBMS"),
    "ORA-00312": ("OBJECT_LOCATOR", "Identifies affected online redo log member"),
    "ORA-00353": ("FATAL_DB_SYMPTOM", "Redo log corruption or unreadable redo"),
    "ORA-15080": ("ASM_CONSEQUENCE", "ASM synchronous disk I/O failure"),
    "ORA-15081": ("ASM_CONSEQUENCE", "ASM failed to submit I/O to disk"),
    "ORA-15130": ("ASM_CONSEQUENCE", "ASM diskgroup dismount / escalation"),
}
PLACEHOLDER = "See Oracle error documentation / PDF runbook."
GENERIC_PATTERNS = ("ORA_ANY_GENERIC", "GENERIC_ORA_EXTRACT")
CELL_PATTERNS = ("EXA_FLASH_FAIL", "EXA_CELL_IO_ERROR")
KINDS = {"STORAGE_PATTERN": "STORAGE", "OS_PATTERN": "OS", "ASM_PATTERN": "ASM", "TNS": "NETWORK"}
PREVIEW, TIMELINE, NO_TIME = 220, 40, "(no parseable ts)"
# -----------------------------------------------------------------------------

EVENT = ("path", "line_index", "timestamp_raw", "layer", "process", "ora_codes", "os_errno", "trace_file", "diskgroup", "au", "offset", "device", "severity", "preview")


def _some(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _any_group(text: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[group(text, pattern, g) for g in groups], F.lit(""))


def clipped(text: Column) -> Column:
    return F.concat(F.substring(text, 1, PREVIEW), F.when(F.length(text) > PREVIEW, "…").otherwise(""))


def scan_lines(lines: DataFrame) -> DataFrame:
    """correlation events of lines (path, line_number, line): those of
    eight characters or more that name a code, show a layer or a cell."""
    s = F.trim("line")
    layer = reduce(lambda acc, rule: acc.when(s.rlike(rule[1]), rule[0]), LINE_LAYERS[1:], F.when(s.rlike(LINE_LAYERS[0][1]), LINE_LAYERS[0][0])).otherwise("UNKNOWN")
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?i)\b(ORA-\d{5})\b")))
    rows = lines.where(F.length(s) >= 8).withColumn("layer", layer).withColumn("ora_codes", codes)
    rows = rows.where((F.size("ora_codes") > 0) | (F.col("layer") != "UNKNOWN"))
    process = F.coalesce(*[group(s, rf"(?i)\b({p}\d*)\b") for p in PROCESSES], F.lit(""))
    return rows.select(
        "path", (F.col("line_number") - 1).cast("int").alias("line_index"), F.coalesce(*[group(s, p) for p in LINE_TIMES], F.lit("")).alias("timestamp_raw"), "layer", process.alias("process"), "ora_codes",
        _any_group(s, LINE_ERRNO, 1, 2, 3).alias("os_errno"), _any_group(s, LINE_TRACE, 1).alias("trace_file"), _any_group(s, LINE_DISKGROUP, 1, 2).alias("diskgroup"),
        _any_group(s, LINE_READ_FAILED, 2).alias("au"), _any_group(s, LINE_READ_FAILED, 3).alias("offset"), _any_group(s, LINE_DEVICE, 1, 2, 3).alias("device"),
        F.when(s.rlike(r"(?i)FATAL|TERMINATING|FAILED"), "CRITICAL").otherwise("ERROR").alias("severity"), clipped(s).alias("preview"),
    )


def project_events(events: DataFrame) -> DataFrame:
    """normalized events as correlation events."""
    kind, code = F.upper(F.trim(_some(F.col("code_type")))), F.trim(_some(F.col("code")))
    own = F.upper(F.trim(_some(F.col("layer"))))
    own = F.when((own == "INFRA") & ((_some(F.col("cell")) != "") | (_some(F.col("flash_disk")) != "")), "STORAGE").otherwise(own)
    vendor = (kind == "ORA") & code.rlike(r"(?i)^ORA-\d{5}$")
    by_kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind)
    known = F.nullif(normal_layer(own), F.lit("UNKNOWN"))
    layer = F.coalesce(F.when(vendor, "DB"), known, by_kind, F.when(code.rlike(r"(?i)^TNS-\d+"), "NETWORK"), category_layer(F.col("failure_family")))
    raw = _some(F.col("raw"))
    text = F.substring(F.coalesce("preview", raw), 1, PREVIEW)
    return events.select(
        F.coalesce("source_path", "source_file", F.lit("")).alias("path"), F.greatest(F.coalesce("line_number", F.lit(1)) - 1, F.lit(0)).cast("int").alias("line_index"),
        F.coalesce("timestamp_raw", F.col("timestamp").cast("string"), F.lit("")).alias("timestamp_raw"), layer.alias("layer"), F.substring(_some(F.col("process")), 1, 64).alias("process"),
        F.when(vendor, F.array(F.upper(code))).otherwise(F.array().cast("array<string>")).alias("ora_codes"), _some(F.col("os_errno")).alias("os_errno"), F.substring(_some(F.col("trace_file")), 1, 512).alias("trace_file"),
        F.substring(_some(F.col("diskgroup")), 1, 64).alias("diskgroup"), _some(F.col("au")).alias("au"), _some(F.col("offset")).alias("offset"),
        F.substring(F.coalesce(F.nullif("device", F.lit("")), "multipath_device", F.lit("")), 1, 64).alias("device"), F.upper(F.coalesce("severity", F.lit("ERROR"))).alias("severity"),
        F.concat(text, F.when((F.length(raw) > PREVIEW) & ~text.endswith("…"), "…").otherwise("")).alias("preview"),
    )


def merge_events(normalized: DataFrame, scanned: DataFrame) -> DataFrame:
    """U4: events of both kinds (EVENT), one for each line, codes and start of
    text; the normalized one counts."""
    both = normalized.select(*EVENT, F.lit(0).alias("_from")).unionByName(scanned.select(*EVENT, F.lit(1).alias("_from")))
    keys = ["path", "line_index", F.array_join("ora_codes", ","), F.substring("preview", 1, 120)]
    return first_wins(both, keys, ["_from", "preview", "layer", "device"]).drop("_from")


def event_keys(events: DataFrame, key: str = "incident") -> DataFrame:
    """What an incident's correlation events name: sorted sets, one row each."""
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return events.groupBy(key).agg(
        names("device").alias("devices"), names("diskgroup").alias("diskgroups"), names("trace_file").alias("trace_files"), names("process").alias("processes"), names("layer").alias("layers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ora_codes")))).alias("oras"), F.max(F.col("preview").rlike(LGWR_TERMINATION)).alias("terminated"),
    )


def _named(label: str, values: str, when: Column | None = None) -> Column:
    ok = F.size(values) > 0
    return F.when(ok if when is None else ok & when, F.concat(F.lit(f"{label}="), F.array_join(values, ",")))


def correlation_key(ora: Column, au: Column) -> Column:
    """What a code's row has in common with its incident (``event_keys``)."""
    parts = [
        _named("device", "devices"), _named("diskgroup", "diskgroups", F.upper(ora).startswith("ORA-15")), _named("trace", "trace_files"),
        _named("process", "processes", ora.isin("ORA-00353", "ORA-00312", "ORA-27072")), _named("layers", "layers"), F.when(au != "", F.concat(F.lit("AU="), au)),
    ]
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("time_window + log co-location"))


def ora_meaning(code: Column, extracted: Column | None = None, catalog: Column | None = None) -> Column:
    """The extracted meaning of a code, else the catalogue's, else that
    there is none.  (Asking a hosted model between these steps is left out.)"""
    none = F.lit(None).cast("string")
    found = none if extracted is None else F.nullif(F.trim(extracted), F.lit(""))
    listed = none if catalog is None else F.nullif(F.nullif(F.trim(catalog), F.lit("")), F.lit(PLACEHOLDER))
    return F.coalesce(found, listed, F.concat(F.upper(F.trim(code)), F.lit(": definition not in the message extract — verify in the error messages reference.")))


def ora_rows(events: DataFrame, key: str = "incident", meanings: DataFrame | None = None) -> DataFrame:
    """A row for each code of an incident: layer, role, meaning, first
    evidence, key.  ``meanings``: (error, extracted) of a message extract."""
    keys = event_keys(events, key)
    codes = events.select(key, "line_index", "preview", "au", F.explode("ora_codes").alias("error")).withColumn("error", F.upper("error"))
    first = codes.groupBy(key, "error").agg(F.min(F.struct("line_index", "preview", "au")).alias("f"))
    rows = first.join(keys, key)
    rows = rows.join(meanings.select("error", "extracted"), "error", "left") if meanings is not None else rows.withColumn("extracted", F.lit(None).cast("string"))
    e = F.col("error")
    table = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, v in ORA_CATALOG.items() for x in (c, v[k])]), e)
    layer = F.when(e.rlike("^ORA-15[01]"), "ASM").when(e.startswith("ORA-003") | (e == "ORA-27072"), "RDBMS").otherwise("DB")
    order = Window.partitionBy(key).orderBy(cascade_order(e), "error")
    return rows.select(
        key, "error", layer.alias("layer"), F.coalesce(table(0), F.lit("POSSIBLY_RELATED")).alias("role"), ora_meaning(e, F.col("extracted"), table(1)).alias("meaning"),
        F.col("f.preview").alias("evidence_preview"), correlation_key(e, F.col("f.au")).alias("correlation_key"), F.row_number().over(order).alias("cascade_rank"),
    )


def non_ora_rows(events: DataFrame, patterns: DataFrame, key: str = "incident") -> DataFrame:
    """(event, row_kind, layer, role, evidence_preview) of what isn't a
    code: the log writer's end, flash timeouts, matched patterns (incident,
    pattern_id)."""
    first = lambda rows: rows.groupBy(key).agg(F.min_by("preview", "line_index").alias("evidence_preview"))
    row = lambda df, event, kind, layer, role: df.select(
        key, *[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in (("event", event), ("row_kind", kind), ("layer", layer), ("role", role))], "evidence_preview"
    )
    ended = row(first(events.where(F.col("preview").rlike(LGWR_TERMINATION))), "LGWR_INSTANCE_TERMINATION", "NON_ORA_EVENT", "DB", "FINAL_IMPACT")
    flash = row(first(events.where((F.col("layer") == "STORAGE") & F.upper("preview").contains("FLASH_IO_TIMEOUT"))), "FLASH_IO_TIMEOUT", "STORAGE_SIGNAL", "STORAGE", "ROOT_CAUSE")
    matched = patterns.where(~F.col("pattern_id").isin(*GENERIC_PATTERNS)).select(key, "pattern_id", F.lit("(matched in direct input / chunk text)").alias("evidence_preview")).distinct()
    matched = row(matched, F.col("pattern_id"), "PATTERN_MATCH", pattern_layer(F.col("pattern_id")), F.when(F.col("pattern_id").isin(*CELL_PATTERNS), "ROOT_CAUSE").otherwise("INTERMEDIATE_CAUSE"))
    return ended.unionByName(flash).unionByName(matched)


def marked_cascade(layers: Column, patterns: Column, oras: Column, chain: Column, terminated: Column) -> Column:
    """The steps of a cascade, deepest first, each marked as confirmed or
    inferred, or as lacking evidence.  ``chain``: steps known already."""
    storage, os_ = has(layers, "STORAGE"), has(layers, "OS")
    cell = has(patterns, *CELL_PATTERNS)
    asm = F.exists(oras, lambda o: F.upper(o).rlike("^ORA-15[01]"))
    deep = deepest_pattern(patterns)
    steps = lambda *values: F.array_compact(F.array(*values))
    says = lambda text, mark="CONFIRMED": F.concat(text if isinstance(text, Column) else F.lit(text), F.lit(f" [{mark}]"))
    bridge = F.exists(chain, lambda s: s.rlike(r"(^|\s)(ORA-27072|ORA-15080|ORA-15130)(\s|$)"))
    deepest = (
        F.when(storage, says("STORAGE_FLASH_IO_OR_MEDIA_FAILURE")).when(F.coalesce(deep["pattern"].isin(*CELL_PATTERNS) | (deep["layer"] == "STORAGE"), F.lit(False)), says(deep["pattern"]))
        .when(has(layers, "INFRA"), says("STORAGE/INFRA")).when(bridge, "[NEEDS_EVIDENCE: storage/cell/SAN logs to confirm deepest root]")
    )
    head = steps(F.when(~storage & ~cell & asm, "[NEEDS_EVIDENCE: storage/cell/SAN logs to confirm deepest backend root]"), deepest)
    paths = steps(*[F.when(has(patterns, p), F.when(os_, says(p)).otherwise(says(p, "INFERRED"))) for p in OS_PATH_PATTERNS])
    known = F.transform(F.filter(chain, lambda s: s.rlike("^(DB|ROOT|OS|ASM):")), lambda s: F.when(s.contains("[NEEDS_EVIDENCE"), s).otherwise(says(s)))
    ranked = F.array_sort(F.transform(F.array_distinct(oras), lambda o: F.struct(cascade_order(o).alias("at"), o.alias("ora"))))
    codes = F.transform(ranked, lambda r: says(F.concat(F.when(F.upper(r["ora"]).rlike("^ORA-15[01]"), "ASM: ").otherwise("DB: "), r["ora"])))
    own = F.when(F.size(chain) == 0, codes).otherwise(F.array().cast("array<string>"))
    before = F.concat(head, paths, known, own)
    end = steps(F.when(terminated & ~F.exists(before, lambda s: s.contains("LGWR_INSTANCE_TERMINATION")), says("DB: LGWR_INSTANCE_TERMINATION")))
    hint = steps(F.when(~os_ & has(patterns, *OS_PATH_PATTERNS[:3]), "[INFERRED: OS path symptoms from pattern match — confirm with host logs]"))
    return F.concat(before, end, hint)


def timeline(events: DataFrame, key: str = "incident", most: int = TIMELINE) -> DataFrame:
    """The first events of an incident by the spelling of their times."""
    at = F.coalesce(F.nullif("timestamp_raw", F.lit("")), F.lit(NO_TIME))
    named = F.coalesce(F.nullif(F.array_join("ora_codes", ", "), F.lit("")), F.substring("preview", 1, 80))
    place = Window.partitionBy(key).orderBy("timestamp", "line_index", "preview")
    rows = events.withColumn("timestamp", at).withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return rows.select(key, "place", "timestamp", "layer", named.alias("event"), "preview")


def recent(patterns: DataFrame, most: int = 20) -> DataFrame:
    """The stored patterns that came last."""
    return patterns.orderBy(F.desc("created_at"), "incident_id").limit(most)


def cascades_of(cascades: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The cascades (cascade_id, root_pattern, …) of roots (root_pattern),
    the first of each; all without ``roots``."""
    if roots is None:
        return cascades
    return first_wins(cascades.join(roots.select("root_pattern").distinct(), "root_pattern", "left_semi"), ["root_pattern"], ["cascade_id"])


def embed_text(category: Column, severity: Column, ora: Column, platform: Column, pattern: Column, text: Column) -> Column:
    """A chunk's text after what is known of it, as embedders get it."""
    labels = (("CATEGORY", category), ("SEVERITY", severity), ("ORA", ora), ("PLATFORM", platform), ("PATTERN", pattern))
    return F.trim(F.concat(*[F.concat(F.lit(f"{n}:"), _some(v), F.lit(" ")) for n, v in labels], _some(text)))


def query_text(query: Column, ora: Column, platform: Column) -> Column:
    """A query after the code and platform that are known."""
    part = lambda label, v: F.when(_some(v) != "", F.concat(F.lit(f"{label}:"), v, F.lit(" "))).otherwise("")
    return F.trim(F.concat(part("ORA", ora), part("PLATFORM", platform), _some(query)))


def append_session(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K5: new chunks (session_id, hostname, timestamp, content, file_source)
    after a session's stored ones, with an id from what they say; a chunk that
    is stored already isn't added again."""
    digest = F.sha2(F.concat_ws("|", "session_id", "file_source", F.col("timestamp").cast("string"), "content"), 256)
    rows = new.withColumn("hostname", F.coalesce("hostname", F.lit("unknown"))).withColumn("chunk_id", F.concat(F.lit("CHK-"), F.substring(digest, 1, 12)))
    rows = rows.dropDuplicates(["session_id", "chunk_id"]).join(stored.select("session_id", "chunk_id"), ["session_id", "chunk_id"], "left_anti")
    return stored.unionByName(rows.select(*stored.columns))


def language_hints(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Codes that the words of a question suggest: rules (regex, codes)
    in order, each code once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(text.rlike(f"(?i){p}"), F.array(*[F.lit(c) for c in codes])).otherwise(none) for p, codes in rules])))


def payload_evidence(chunks: DataFrame, key: str = "incident", most: int = 5) -> DataFrame:
    """Of retrieved chunks the traces, security events and hardware, as
    short lists: (kind, place, chunk_id, excerpt)."""
    c = F.upper(_some(F.col("category")))
    source, text = F.upper(_some(F.col("log_source"))), F.upper(_some(F.col("raw_text")))
    kinds = F.array_compact(F.array(
        F.when((_some(F.col("trace_path")) != "") | source.contains("TRACE") | text.contains(".TRC"), "trace"),
        F.when((c == "SECURITY") | source.rlike("AUDIT|SECURE"), "security"),
        F.when(c.isin("HARDWARE", "DISK", "STORAGE") | (_some(F.col("device")) != ""), "hardware"),
    ))
    place = Window.partitionBy(key, "kind").orderBy(F.desc("score"), "chunk_id")
    rows = chunks.withColumn("kind", F.explode(kinds)).withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    return rows.select(key, "kind", "place", "chunk_id", F.substring("raw_text", 1, PREVIEW).alias("excerpt"))


def report_text(reports: DataFrame) -> DataFrame:
    """K7: a report (incident, report_status, root_cause, rca_status, rca_score,
    steps, fixes) as plain text and as an HTML fragment, in columns."""
    escape = lambda c: reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), c)
    head = [("Incident", F.col("incident").cast("string")), ("Status", F.col("report_status")), ("Root cause", F.col("root_cause")), ("Confidence", F.concat_ws(" ", "rca_status", F.format_number("rca_score", 1)))]
    lists = (("Cascade", "steps"), ("Fixes", "fixes"))
    plain = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), _some(v)) for n, v in head], *[F.when(F.size(c) > 0, F.concat(F.lit(f"{n}:\n"), F.array_join(F.transform(c, lambda s: F.concat(F.lit("  - "), s)), "\n"))) for n, c in lists])
    rows = F.concat(*[F.concat(F.lit(f"<tr><th>{n}</th><td>"), escape(_some(v)), F.lit("</td></tr>")) for n, v in head])
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"<h2>{n}</h2><ol>"), F.array_join(F.transform(c, lambda s: F.concat(F.lit("<li>"), escape(s), F.lit("</li>"))), ""), F.lit("</ol>"))).otherwise("") for n, c in lists]
    return reports.select("incident", plain.alias("text"), F.concat(F.lit("<table>"), rows, F.lit("</table>"), *parts).alias("html"))


def write_packages(reports: DataFrame, folder: str) -> DataFrame:
    """K6: for each incident (incident, findings, html, traces map) a zip with
    findings.json, report.html and its traces; (incident, path, n_files).
    A file has its name once it is whole."""
    from faultline.sources.files import write_whole

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                members = {"findings.json": r["findings"] or "{}", "report.html": r["html"] or ""}
                members |= {f"traces/{k.rpartition('/')[2]}": v or "" for k, v in sorted(r["traces"] or [])}
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in members.items():
                        z.writestr(zipfile.ZipInfo(name), text)
                path = f"{folder.rstrip('/')}/{r['incident']}.zip"
                write_whole(path, packed.getvalue())
                out.append((r["incident"], path, len(members)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["incident", "path", "n_files"])

    rows = reports.select(F.col("incident").cast("string").alias("incident"), "findings", "html", "traces")
    return rows.mapInArrow(run, "incident string, path string, n_files int")
