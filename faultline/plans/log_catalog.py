"""Queries of the parsers: logs written from the event table and read back,
each with SQL that says from the table what has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.time import infer_years
from faultline.operators import parsers as P
from faultline.plans import diagnose as D
from faultline.plans.catalog import query
from faultline.plans.frames import table
from faultline.sources import files as S

def event_id() -> Column:
    return F.col("event_id")


def user_id() -> Column:
    return F.col("user_id")


def event_type() -> Column:
    return F.col("event_type")


def stamp(form: str) -> Column:
    return F.date_format("ts", form)


def text(*parts) -> Column:
    """Parts of a line: strings stand for themselves, columns for values."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def by_type(default: Column | None = None, **values: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in values.items():
        out = out.when(event_type() == name, value)
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def event_files(spark, sf_dir: str, content: Column) -> DataFrame:
    """A small file for each event: (path, text)."""
    return table(spark, sf_dir, "events").select(text("e", F.col("event_id")).alias("path"), content.alias("text")).where("text is not null")


def host_lines(spark, sf_dir: str, line: Column) -> DataFrame:
    """A file for each host, its lines numbered by events."""
    return table(spark, sf_dir, "events").select(text("host", F.col("user_id")).alias("path"), F.col("event_id").cast("int").alias("line_number"), line.alias("line"))


def event_lines(spark, sf_dir: str, content: Column) -> DataFrame:
    return P.lines_of(event_files(spark, sf_dir, content))


def ntz(column: str = "timestamp") -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def long(column: str) -> Column:
    return F.col(column).cast("long").alias(column)


# syslog --------------------------------------------------------------------------


@query("""WITH l AS (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block FROM events)
SELECT 'host' || user_id AS path, min(event_id) AS line_number, 'host' || user_id AS host, max(CASE WHEN event_type <> 'view' THEN event_type END) AS process, CAST(min(event_id) AS VARCHAR) AS pid,
 string_agg(CASE WHEN event_type <> 'view' THEN 'value ' || props ELSE 'more ' || event_id END, ' ' ORDER BY event_id) AS message, date_trunc('second', min(ts)) AS timestamp, 'MEDIUM' AS timestamp_confidence, 'RFC3164' AS format
FROM l WHERE block > 0 GROUP BY user_id, block""")
def syslog_continuations(spark, sf_dir):
    """Entries with continuation lines, their year from a year table."""
    line = F.when(event_type() == "view", text("   more ", event_id())).otherwise(text(stamp("MMM d HH:mm:ss"), " host", user_id(), " ", event_type(), "[", event_id(), "]: value ", F.col("props")))
    lines = host_lines(spark, sf_dir, line)
    out = P.parse_syslog(lines, lines.select("path").distinct().withColumn("year", F.lit(2024)))
    return out.select("path", long("line_number"), "host", "process", "pid", "message", ntz(), "timestamp_confidence", "format")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events)
SELECT 'host' || user_id AS path, CAST(CASE WHEN min(line) % 2 = 0 THEN 2023 ELSE 2024 END AS INTEGER) AS year FROM l WHERE line <= 5 AND event_type = 'error' GROUP BY user_id""")
def year_inference(spark, sf_dir):
    """The year of the first line with a whole date, if it is one of a
    file's first five."""
    number = F.row_number().over(_by_host())
    dated = text(F.when(F.col("line_number") % 2 == 0, "2023").otherwise("2024"), stamp("-MM-dd HH:mm:ss"), " x")
    rows = table(spark, sf_dir, "events").withColumn("line_number", number)
    lines = rows.select(text("host", user_id()).alias("path"), "line_number", F.when(event_type() == "error", dated).otherwise(text(stamp("MMM d HH:mm:ss"), " host x: y")).alias("line"))
    return infer_years(lines, 5)


def _by_host():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, code, severity, device, multipath, block FROM events JOIN (VALUES
 ('error', 'SCSI_DISK_TIMEOUT', 'CRITICAL', 'sdb', NULL), ('error', 'OS_BLOCK_IO_ERROR', 'ERROR', 'sdb', NULL), ('signup', 'MULTIPATH_ALL_PATHS_DOWN', 'CRITICAL', NULL, 'mpatha'),
 ('purchase', 'OS_OOM_KILLER', 'CRITICAL', NULL, NULL), ('click', 'DEVICE_OFFLINE', 'CRITICAL', NULL, NULL)) s(event_type, code, severity, device, multipath) USING (event_type),
 LATERAL (SELECT CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END AS block)""")
def syslog_signals(spark, sf_dir):
    """A message gives an event for each signal it shows."""
    message = by_type(
        text("nothing to see"), error=text("sd 2:0:0:1: hostbyte=DID_TIME_OUT blk_update_request: I/O error, dev sdb, sector ", event_id()), signup=text("mpatha: remaining active paths: 0"),
        purchase=text("Out of memory: Killed process ", event_id()), click=text("rejecting I/O to offline device"),
    )
    entries = P.parse_syslog(host_lines(spark, sf_dir, text(stamp("yyyy-MM-dd'T'HH:mm:ss"), "Z host", user_id(), " kernel: ", message)))
    return P.syslog_events(entries).select(F.col("source_path").alias("path"), long("line_number"), "code", "severity", "device", F.col("multipath_device").alias("multipath"), "block")


# alert logs -----------------------------------------------------------------------

_CLASSIC = "EEE MMM d HH:mm:ss yyyy"


@query("""SELECT 'e' || event_id AS path, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRITICAL' WHEN 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS severity,
 CASE event_type WHEN 'error' THEN 'ORA-27072' WHEN 'signup' THEN 'ORA-15130,ORA-27072' ELSE '' END AS codes, CASE WHEN event_type = 'error' THEN CAST(event_id % 7 + 1 AS VARCHAR) END AS errno,
 CASE WHEN event_type = 'error' THEN '/u01/diag/trace/db_' || event_id || '.trc' END AS trace_path, CASE WHEN event_type = 'error' THEN '/u01/diag/trace' END AS incident_path,
 CASE WHEN event_type = 'error' THEN CAST(4000 + event_id AS VARCHAR) END AS incident_id, CASE WHEN event_type = 'signup' THEN 'PDB' || user_id END AS pdb_name,
 CASE WHEN event_type = 'purchase' THEN 'PMON' END AS process_died, CASE WHEN event_type = 'click' THEN 'Starting ORACLE instance' END AS instance_message, date_trunc('second', ts) AS timestamp
FROM events WHERE event_type <> 'view'""")
def alert_blocks(spark, sf_dir):
    """Blocks that time lines open; what comes before one is none."""
    at = stamp(_CLASSIC)
    content = by_type(
        text("ORA-00600: without a time"),
        error=text(at, "\nErrors in file /u01/diag/trace/db_", event_id(), ".trc (incident=", 4000 + event_id(), "):\nORA-27072: File I/O error\nLinux-x86_64 Error: ", event_id() % 7 + 1, ": Input/output error\nORA-27072: again"),
        signup=text(at, "\n[PDB", user_id(), "] ORA-15130: diskgroup is being dismounted\nORA-27072: File I/O error"), purchase=text(at, "\nPMON: process ", event_id(), " died"), click=text(at, "\nStarting ORACLE instance (normal)"),
    )
    out = P.parse_alert_blocks(event_lines(spark, sf_dir, content))
    return out.select("path", "severity", F.array_join("ora_codes", ",").alias("codes"), "errno", "trace_path", "incident_path", "incident_id", "pdb_name", "process_died", "instance_message", ntz())


@query("""SELECT 'e' || event_id AS path, CAST(3 + least(event_id % 12, 5) + CASE WHEN event_id % 12 > 5 THEN 1 ELSE 0 END AS BIGINT) AS n_lines, event_id % 12 > 5 AS cut, 'ORA-07445' AS codes FROM events""")
def sql_dump_cut(spark, sf_dir):
    """P5: five lines of a dumped statement stay."""
    dump = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.concat(F.lit("select "), k.cast("string"), F.lit("\n")))
    content = text(stamp(_CLASSIC), "\nCurrent SQL statement:\n", F.array_join(F.slice(dump, F.lit(1), (event_id() % 12).cast("int")), ""), "ORA-07445: y")
    out = P.parse_alert_blocks(event_lines(spark, sf_dir, content))
    return out.select("path", F.size("lines").cast("long").alias("n_lines"), F.exists("lines", lambda x: x.contains("TRUNCATED")).alias("cut"), F.array_join("ora_codes", ",").alias("codes"))


@query("""SELECT 'e' || event_id AS path, CAST(line_number AS BIGINT) AS line_number, code, severity, layer, date_trunc('second', ts) AS timestamp, 'HIGH' AS timestamp_confidence, role_hint, failure_family,
 CASE WHEN line_number IN (2, 3) THEN '5' END AS os_errno, CASE WHEN line_number = 4 THEN CAST(event_id % 4 AS VARCHAR) END AS redo_group, CASE WHEN line_number = 4 THEN '/redo/log' || event_id || '.rdo' END AS file_path,
 CASE WHEN line_number = 5 THEN CAST(event_id AS VARCHAR) END AS block, CASE WHEN line_number = 5 THEN '03/07/2024 02:40:00' END AS corruption_time,
 CASE WHEN line_number = 6 THEN 'ORA-00353' END AS mapped_code_hint, CASE WHEN line_number = 6 THEN CAST(event_id AS VARCHAR) END AS pid
FROM events, (VALUES (2, 'ORA-27072', 'ERROR', 'DB', 'DB_IO_SYMPTOM', 'IO'), (3, 'OS_ERRNO_5', 'ERROR', 'OS', NULL, 'IO'), (4, 'ORA-00312', 'ERROR', 'DB', 'OBJECT_LOCATOR', 'REDO'),
 (5, 'ORA-00353', 'CRITICAL', 'DB', 'FATAL_DB_SYMPTOM', 'REDO_CORRUPTION'), (6, 'LGWR_INSTANCE_TERMINATION', 'CRITICAL', 'DB', 'FINAL_IMPACT', 'INSTANCE_TERMINATION'),
 (7, 'ORA-15080', 'ERROR', 'ASM', 'ASM_CONSEQUENCE', 'ASM')) r(line_number, code, severity, layer, role_hint, failure_family) WHERE event_type = 'error'""")
def alert_log_events(spark, sf_dir):
    """Telling lines, with the time of the last line that has its own."""
    content = text(
        stamp("yyyy-MM-dd'T'HH:mm:ss"), "+00:00\nORA-27072: File I/O error\nLinux-x86_64 Error: 5: Input/output error\nORA-00312: online log ", event_id() % 4, " thread 1: '/redo/log", event_id(),
        ".rdo'\nORA-00353: log corruption near block ", event_id(), " change 1 time 03/07/2024 02:40:00\nLGWR (ospid: ", event_id(), "): terminating the instance due to error 353\nORA-15080: synchronous I/O failed\nall is well",
    )
    out = P.alert_events(event_lines(spark, sf_dir, by_type(error=content)))
    return out.select(
        F.col("source_path").alias("path"), long("line_number"), "code", "severity", "layer", ntz(), "timestamp_confidence", "role_hint", "failure_family", "os_errno", "redo_group", "file_path", "block",
        F.col("details")["corruption_time"].alias("corruption_time"), "mapped_code_hint", "pid",
    )


@query("""SELECT 'e' || event_id AS path, code, code_type, severity, CASE event_type WHEN 'signup' THEN CAST(event_id % 5 AS VARCHAR) WHEN 'purchase' THEN '1' END AS asm_group,
 CASE WHEN event_type = 'signup' THEN 'DATA' || user_id END AS diskgroup, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS asm_disk, CASE WHEN event_type = 'purchase' THEN '4' END AS offset_value
FROM events JOIN (VALUES ('signup', 'ASM_DISMOUNT_PROGRESS', 'ASM_PATTERN', 'WARNING'), ('purchase', 'ASM_READ_FAILED', 'ASM_PATTERN', 'CRITICAL'), ('click', 'ORA-15080', 'ORA', 'ERROR'),
 ('click', 'ORA-15081', 'ORA', 'ERROR')) a(event_type, code, code_type, severity) USING (event_type)""")
def asm_fragments(spark, sf_dir):
    """Fragments of storage-manager logs; a line that starts with the code
    is the alert log's, a cell's line the cell's."""
    failed = text("Read Failed. group:1 disk:", event_id(), " AU:3 offset:4 size:5")
    content = by_type(
        text("CELLSRV: ", failed), error=text("ORA-15130: diskgroup DATA is being dismounted"), signup=text("cache dismounting group ", event_id() % 5, " (DATA", user_id(), ")"), purchase=failed,
        click=text("saw ORA-15080 and ora-15081, ORA-15080"),
    )
    out = P.asm_events(event_lines(spark, sf_dir, content))
    return out.select(F.col("source_path").alias("path"), "code", "code_type", "severity", "asm_group", "diskgroup", "asm_disk", F.col("offset").alias("offset_value"))


# cells, clusters, other systems -------------------------------------------------------


@query("""SELECT 'e' || event_id AS path, code, severity, CASE WHEN event_type = 'error' THEN 'cell' || user_id ELSE 'unknown' END AS cell, component, date_trunc('second', ts) AS timestamp,
 CASE WHEN event_type = 'error' THEN 'FD_' || event_id END AS flash_disk, CASE WHEN event_type = 'error' THEN 'CD_03' END AS cell_disk, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS asm_disk,
 CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n_lines
FROM events JOIN (VALUES ('error', 'FLASH_IO_TIMEOUT', 'CRITICAL', 'CELLSRV'), ('purchase', 'STORAGE_ASM_READ_FAILED', 'ERROR', 'CELLSRV'), ('click', 'STORAGE_MEDIA_READ_FAILURE', 'CRITICAL', 'RS'),
 ('view', 'CELL_INFORMATIONAL', 'INFO', 'MS')) c(event_type, code, severity, component) USING (event_type)""")
def cell_entries(spark, sf_dir):
    """Storage-cell entries with continuation lines; benign ones go."""
    at = stamp("yyyy-MM-dd'T'HH:mm:ss")
    content = by_type(
        text(at, " MS: hello"), error=text(at, "+00:00 cell", user_id(), " CELLSRV: warningCode=FLASH_IO_TIMEOUT flashDisk=FD_", event_id(), " cellDisk=CD_03\n detail ", event_id()), signup=text(at, " MS: no alerts in this interval"),
        purchase=text(at, " CELLSRV: Read Failed. group:1 disk:", event_id(), " AU:3 offset:4 size:5"), click=text(at, " RS: FD_02 on CD_09 requires replacement"),
    )
    out = P.cell_events(event_lines(spark, sf_dir, content))
    return out.select(F.col("source_path").alias("path"), "code", "severity", "cell", "component", ntz(), "flash_disk", "cell_disk", "asm_disk", F.size(F.split("raw", "\n")).alias("n_lines"))


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, crs_code, component, severity, os_pattern, is_eviction, is_false_positive, CASE WHEN event_type = 'error' THEN 'node' || user_id END AS affected_node,
 CASE WHEN event_type = 'purchase' THEN 'ora.db' || user_id END AS resource_name, ts AS timestamp
FROM events JOIN (VALUES ('error', 'CRS-1618', 'CSSD', 'CRITICAL', 'BONDING_FAILOVER_EVENT', true, false), ('purchase', 'CRS-2676', 'CRSD', 'INFO', NULL, false, true),
 ('signup', 'CRS-5011', 'OHASD', 'CRITICAL', 'NTP_TIME_JUMP', false, false), ('click', 'CRS-9999', 'EVMD', 'ERROR', NULL, false, false)) c(event_type, crs_code, component, severity, os_pattern, is_eviction, is_false_positive) USING (event_type)""")
def crs_lines(spark, sf_dir):
    """P12"""
    at = stamp("yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = by_type(
        text("noise"), error=text(at, " [CSSD]CRS-1618: Node node", user_id(), " is not responding"), purchase=text(at, " [CRSD] Start of resource 'ora.db", user_id(), "' succeeded CRS-2676"), signup=text(at, " [OHASD]CRS-5011: time jump"),
        click=text(at, " [EVMD]CRS-9999: something"),
    )
    out = P.parse_crs(host_lines(spark, sf_dir, line))
    return out.select("path", long("line_number"), "crs_code", "component", "severity", "os_pattern", "is_eviction", "is_false_positive", "affected_node", "resource_name", ntz())


@query("""SELECT 'e' || event_id AS path, 0 AS record, 'a' || event_id AS name, CAST(user_id AS VARCHAR) AS size, NULL AS kind FROM events
UNION ALL SELECT 'e' || event_id, 1, 'b:' || event_id, NULL, event_type || ' x' FROM events""")
def key_value_records(spark, sf_dir):
    """Records of keys and values, between blank lines."""
    content = text("name: a", event_id(), "\nsize:  ", user_id(), "\n\nname: b:", event_id(), "\n  kind: ", event_type(), " x \nno pair")
    out = P.parse_records(event_lines(spark, sf_dir, content))
    return out.select("path", F.col("record").cast("int").alias("record"), *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("name", "size", "kind")])


@query("""SELECT 'e' || event_id AS path, label, severity, os_pattern, category, 'hdisk' || event_id AS resource, 'aix' || user_id AS hostname, date_trunc('second', ts) AS timestamp, 'DISK OPERATION ERROR' AS description
FROM events JOIN (VALUES ('error', 'DISK_ERR7', 'CRITICAL', 'SCSI_DISK_TIMEOUT', 'DISK'), ('signup', 'FS_FULL', 'WARNING', 'FILESYSTEM_ARCH_FULL', 'MEMORY'), ('purchase', 'SOMETHING', 'ERROR', NULL, 'KERNEL'))
 a(event_type, label, severity, os_pattern, category) USING (event_type)""")
def aix_error_reports(spark, sf_dir):
    """Reports split at dashed lines; an entry without a label is none."""
    entry = lambda label, kind, cls: text(f"LABEL:\t\t{label}\nIDENTIFIER:\tDE3B8540\n\nDate/Time:       ", stamp("EEE MMM dd HH:mm:ss"), " IST ", stamp("yyyy"), "\nNode Id:         aix", user_id(), f"\nClass:           {cls}\nType:            {kind}\nResource Name:   hdisk", event_id(), "\n\nDescription\nDISK OPERATION ERROR\n---------------\nnothing")
    content = by_type(text("no report"), error=entry("DISK_ERR7", "PERM", "H"), signup=entry("FS_FULL", "PERF", "S"), purchase=entry("SOMETHING", "ODD", "O"))
    out = P.parse_errpt(event_files(spark, sf_dir, content))
    return out.select("path", "label", "severity", "os_pattern", "category", "resource", "hostname", ntz(), "description")


# metrics ------------------------------------------------------------------------------


@query("""SELECT 'e' || event_id AS path, CASE WHEN old THEN 'sdb' ELSE 'sdc' END AS device, await_ms, util_pct, CASE WHEN old THEN 202.0::DOUBLE ELSE CAST(event_id % 50 + 2 AS DOUBLE) END AS iops,
 CASE WHEN old THEN 5.5::DOUBLE ELSE CAST(event_id % 300 AS DOUBLE) END AS r_await, CASE WHEN old THEN 6.4::DOUBLE ELSE 9.0::DOUBLE END AS w_await,
 CASE WHEN util_pct >= 95 THEN 'CRITICAL' WHEN util_pct >= 80 OR await_ms >= 200 THEN 'ERROR' WHEN await_ms >= 100 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM (SELECT event_id, event_type = 'error' AS old, CAST(CASE WHEN event_type = 'error' THEN event_id % 300 ELSE greatest(event_id % 300, 9) END AS DOUBLE) AS await_ms,
 CASE WHEN event_type = 'error' THEN event_id % 100 + 0.5::DOUBLE ELSE CAST(event_id % 101 AS DOUBLE) END AS util_pct FROM events)""")
def iostat_rows(spark, sf_dir):
    """Device rows under either header."""
    old = text("Device: rrqm/s wrqm/s r/s w/s rkB/s wkB/s avgrq-sz avgqu-sz await r_await w_await svctm %util\nsdb 0.00 0.10 82 120 3280 4800 79.5 1.2 ", event_id() % 300, ".0 5.5 6.4 5.8 ", event_id() % 100, ".5\nnot a row")
    new = text("Device r/s w/s rkB/s wkB/s rrqm/s wrqm/s %rrqm %wrqm r_await w_await aqu-sz %util\nsdc ", event_id() % 50, " 2 3 4 5 6 7 8 ", event_id() % 300, " 9.0 1.0 ", event_id() % 101)
    out = P.parse_iostat(event_lines(spark, sf_dir, by_type(new, error=old)))
    return out.select("path", "device", "await_ms", "util_pct", "iops", "r_await", "w_await", "severity")


def _vmstat_line() -> Column:
    return text("  ", event_id() % 12, " ", user_id() % 2, " ", event_id() % 7, " ", 400000 + event_id() * 100, " 1 1 ", event_id() % 900, " ", user_id() % 700, " 1 2 3 4 ", event_id() % 100, " 2 3 ", event_id() % 60)


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, event_id % 900 AS si, user_id % 700 AS so, event_id % 60 AS wa, event_id % 12 AS r, 400000 + event_id * 100 AS free_kb,
 CASE WHEN swap THEN 'CRITICAL' WHEN event_id % 60 > 30 THEN 'ERROR' ELSE 'INFO' END AS severity,
 concat_ws(',', CASE WHEN swap THEN 'MEMORY_SWAP_STORM' END, CASE WHEN event_id % 60 > 30 THEN 'IO_QUEUE_TIMEOUT' END, CASE WHEN event_id % 12 > 8 THEN 'CPU_RUNQUEUE_SATURATION' END) AS patterns
FROM (SELECT *, event_id % 900 > 500 OR user_id % 700 > 500 AS swap FROM events) WHERE event_type <> 'view'""")
def vmstat_samples(spark, sf_dir):
    """P16"""
    out = P.parse_vmstat(host_lines(spark, sf_dir, F.when(event_type() == "view", "procs ---memory---").otherwise(_vmstat_line())))
    return out.select("path", long("line_number"), "si", "so", "wa", "r", "free_kb", "severity", F.array_join("patterns", ",").alias("patterns"))


@query("""SELECT 'host' || user_id AS path, count(*) AS sample_count, max(event_id % 12) AS peak_run_queue, max(user_id % 2) AS peak_blocked, max(event_id % 900) AS peak_swap_in, max(user_id % 700) AS peak_swap_out,
 min(400000 + event_id * 100) AS min_free_mem_kb, max(event_id % 60) AS peak_iowait_pct, max(event_id % 100) AS peak_user_cpu_pct, max(event_id % 7) AS peak_swpd_kb,
 concat_ws(',', CASE WHEN max(event_id % 12) > 8 THEN 'CPU_SATURATION' END, CASE WHEN max(user_id % 2) > 0 THEN 'PROCESS_D_STATE_ZOMBIE' END,
  CASE WHEN max(event_id % 900) > 200 OR max(user_id % 700) > 200 THEN 'MEMORY_PRESSURE' END, CASE WHEN min(400000 + event_id * 100) < 524288 THEN 'LOW_PHYSICAL_MEMORY' END,
  CASE WHEN max(event_id % 60) > 20 THEN 'IO_WAIT_HIGH' END, CASE WHEN max(event_id % 100) > 80 THEN 'CPU_USER_HIGH' END) AS osw_signals
FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def osw_peaks(spark, sf_dir):
    """Peaks of each file's samples, and their signals."""
    out = P.parse_osw(host_lines(spark, sf_dir, F.when(event_type() == "view", text("zzz ***", stamp(_CLASSIC))).otherwise(_vmstat_line())))
    return out.select("path", "sample_count", *[c for c in out.columns if c.startswith(("peak", "min"))], F.array_join("osw_signals", ",").alias("osw_signals"))


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, '/dev/a' || event_id AS filesystem, CAST(event_id % 106 AS INTEGER) AS use_pct, mount,
 CASE WHEN use >= 100 THEN 'CRITICAL' WHEN use >= 95 THEN 'ERROR' WHEN use >= 85 THEN 'WARNING' ELSE 'INFO' END AS severity,
 CASE WHEN use >= 100 AND event_type = 'error' THEN 'FILESYSTEM_ARCH_FULL' WHEN use >= 95 THEN 'FILESYSTEM_ANY_FULL' END AS os_pattern
FROM (SELECT *, event_id % 106 AS use, CASE WHEN event_type = 'error' THEN '/arch' ELSE '/u' END || user_id AS mount FROM events) WHERE event_type <> 'view'""")
def df_rows(spark, sf_dir):
    """File systems but for those in memory."""
    line = F.when(event_type() == "view", text("tmpfs 1G 1G 0 100% /run/", event_id())).otherwise(text("/dev/a", event_id(), " 200G 100G 100G ", event_id() % 106, "% ", F.when(event_type() == "error", "/arch").otherwise("/u"), user_id()))
    return P.parse_df(host_lines(spark, sf_dir, line)).select("path", long("line_number"), "filesystem", "use_pct", "mount", "severity", "os_pattern")


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, event_id % 50 + 0.25::DOUBLE AS user_pct, CAST(event_id % 40 AS DOUBLE) AS steal, CAST(event_id % 30 AS DOUBLE) AS idle,
 CASE WHEN event_id % 30 < 5 THEN 'CRITICAL' WHEN event_id % 40 > 20 THEN 'ERROR' ELSE 'INFO' END AS severity,
 concat_ws(',', CASE WHEN event_id % 40 > 20 THEN 'CPU_STEAL_TIME' END, CASE WHEN event_id % 30 < 5 THEN 'CPU_RUNQUEUE_SATURATION' END) AS patterns
FROM events WHERE event_type <> 'view'""")
def sar_cpu_rows(spark, sf_dir):
    """Rows of all processors together."""
    line = text(stamp("HH:mm:ss"), " AM     ", F.when(event_type() == "view", "0").otherwise("all"), "      ", event_id() % 50, ".25    0.00     1.82     0.12    ", event_id() % 40, "   ", event_id() % 30)
    out = P.parse_sar_cpu(host_lines(spark, sf_dir, line))
    return out.select("path", long("line_number"), F.col("user").alias("user_pct"), "steal", "idle", "severity", F.array_join("patterns", ",").alias("patterns"))


@query("""SELECT 'e' || event_id AS path, 10.0::DOUBLE AS elapsed_mins, CAST(event_id % 50 + 1000 * (event_id % 2) AS DOUBLE) AS db_time_mins, nullif((event_id % 50 + 1000 * (event_id % 2)) / 10, 0) AS db_time_ratio,
 CASE WHEN event_type = 'error' THEN 'latch: shared pool,db file sequential read' WHEN event_type = 'click' THEN 'gc cr request' ELSE '' END AS waits,
 concat_ws(',', CASE WHEN event_type = 'error' THEN 'SHARED_POOL_CONTENTION,IO_SINGLE_BLOCK' WHEN event_type = 'click' THEN 'RAC_GC_CONTENTION' END,
  CASE WHEN event_id % 30 < 10 THEN 'SHARED_POOL_EXHAUSTION' WHEN event_id % 30 < 20 THEN 'SHARED_POOL_LOW' END, CASE WHEN event_type = 'signup' THEN 'HIGH_HARD_PARSE' END,
  CASE WHEN (event_id % 50 + 1000 * (event_id % 2)) / 10 > 1.5 THEN 'DB_TIME_SPIKE' END, CASE WHEN (event_id % 50 + 1000 * (event_id % 2)) / 10 > 3 THEN 'DB_TIME_CRITICAL' END) AS awr_signals
FROM events""")
def awr_reports(spark, sf_dir):
    """P20: load, waits (a name's first line, from half a percent on) and
    memory of performance reports."""
    waits = by_type(
        text("nothing much"),
        error=text("latch: shared pool            32,454   4,521.3    139.3   59.5  Concurrency\ndb file sequential read      198,321   1,234.5      6.2   16.2  User I/O\nlatch: shared pool            1   1.0    1.0   9.5  Concurrency\ntiny wait   1   1.0    1.0   0.1  Other"),
        click=text("gc cr request                 1,000   12.0       1.2     3.0  Cluster"),
    )
    content = text(
        "WORKLOAD REPOSITORY report\nElapsed: 10.00 (mins)\nDB Time: ", F.when(event_id() % 2 == 1, text("1,0", F.lpad((event_id() % 50).cast("string"), 2, "0"))).otherwise((event_id() % 50).cast("string")), ".00 (mins)\nTop 10 Foreground Events by Total Wait Time\n", waits,
        "\nShared Pool Free (%)        ", event_id() % 30, "\nSQL ordered by Elapsed Time\n", F.when(event_type() == "signup", "abcdefghijk12 12.5 3.5 x hard parses").otherwise("quiet"),
    )
    out = P.parse_awr(event_files(spark, sf_dir, content))
    return out.select("path", "elapsed_mins", "db_time_mins", "db_time_ratio", F.array_join(F.transform("top_wait_events", lambda e: e["event"]), ",").alias("waits"), F.array_join("awr_signals", ",").alias("awr_signals"))


# traces, security, audit -----------------------------------------------------------------


@query("""SELECT 'e' || event_id AS path, CAST(event_id + 1 AS VARCHAR) AS pid, 'db' || user_id AS instance_name, 'ksedmp()+' || event_id || chr(10) || 'main()' AS call_stack, 'ksedmp()+' || event_id AS highlights,
 CAST(least(event_id % 40, 30) AS BIGINT) AS error_lines FROM events WHERE event_id % 40 > 0""")
def trace_sections(spark, sf_dir):
    """Header fields outside of sections, sections up to their limits."""
    stack = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.concat(F.lit("\nl"), k.cast("string")))
    content = text(
        "Trace file x\nProcess ID: ", event_id(), "\nInstance name: db", user_id(), "\n----- Call Stack -----\nksedmp()+", event_id(), "\nmain()\n----------------------\nProcess ID: ", event_id() + 1, "\n----- Error Stack -----",
        F.array_join(F.slice(stack, F.lit(1), (event_id() % 40).cast("int")), ""),
    )
    rows = table(spark, sf_dir, "events").where("event_id % 40 > 0").select(text("e", event_id()).alias("path"), content.alias("text"))
    out = P.parse_trace(P.lines_of(rows))
    calls = F.col("sections")["call_stack"]
    return out.select("path", "pid", "instance_name", calls.alias("call_stack"), F.array_join(P.highlighted_frames(calls), ",").alias("highlights"), F.size(F.split(F.col("sections")["error_stack"], "\n")).cast("long").alias("error_lines"))


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, kind AS event_type, severity FROM events JOIN (VALUES ('error', 'ssh_failed', 'WARNING'), ('click', 'ssh_accepted', 'INFO'), ('purchase', 'sudo_exec', 'INFO'),
 ('signup', 'AUTH_FAILURE', 'ERROR')) s(event_type, kind, severity) USING (event_type)""")
def security_lines(spark, sf_dir):
    """Patterns of the manifest, then fallbacks."""
    line = by_type(
        text("all is well"), error=text("sshd: Failed password for invalid user u", user_id(), " from 1.2.3.4 port 22 ssh2"), click=text("sshd: Accepted password for u", user_id(), " from 1.2.3.4 port 22 ssh2"),
        purchase=text("sudo: u", user_id(), " : TTY=x ; PWD=/ ; USER=root ; COMMAND=/bin/ls"), signup=text("ORA-01017: invalid username/password; logon denied"),
    )
    return P.parse_security(host_lines(spark, sf_dir, line)).select("path", long("line_number"), "event_type", "severity")


@query("""SELECT 'e' || event_id AS path, CASE event_type WHEN 'error' THEN 'LOGON' WHEN 'click' THEN 'GRANT DBA' WHEN 'signup' THEN 'DROP USER x' ELSE 'SELECT' END AS action,
 CASE WHEN event_type = 'error' THEN CAST(event_id % 3 * 1000 AS VARCHAR) ELSE '0' END AS returncode, CASE WHEN event_type = 'error' THEN 'U' || user_id END AS userid,
 CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'AUTH_FAILURE' WHEN event_type IN ('click', 'signup') THEN 'PRIVILEGE_CHANGE' END AS event_type,
 CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'ERROR' ELSE 'INFO' END AS severity FROM events""")
def audit_records(spark, sf_dir):
    """Bracketed and plain audit records."""
    content = by_type(
        text("ACTION: SELECT RETURNCODE: 0"), error=text("ACTION : [5] 'LOGON'\nUSERID : [3] 'U", user_id(), "'\nRETURNCODE : [4] '", event_id() % 3 * 1000, "'"), click=text("ACTION: GRANT DBA RETURNCODE: 0"),
        signup=text("ACTION: DROP USER x RETURNCODE: 0"),
    )
    return P.parse_audit(event_files(spark, sf_dir, content)).select("path", "action", "returncode", "userid", "event_type", "severity")


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, 'ib' || event_id % 3 AS port, CAST(event_id % 4 AS INTEGER) AS errors, CAST(user_id % 2 AS INTEGER) AS link_down_count, CASE WHEN user_id % 2 > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 'InfiniBand port ib' || event_id % 3 || ' has ' || event_id % 4 || ' symbol errors and ' || user_id % 2 || ' link down events' AS message FROM events WHERE event_id % 4 > 0 OR user_id % 2 > 0""")
def infiniband_ports(spark, sf_dir):
    """Ports with errors."""
    out = P.parse_exawatcher(host_lines(spark, sf_dir, text("ib", event_id() % 3, " ", event_id() % 4, " 0 ", user_id() % 2)))
    return out.select("path", long("line_number"), "port", "errors", "link_down_count", "severity", "message")


@query("""SELECT 'host' || user_id AS path, event_id AS line_number, code, code_type, severity, parse_confidence, device, diskgroup, trace_file FROM events JOIN (VALUES
 ('error', 'ORA-00600', 'TNS', 'ERROR', 'MEDIUM', NULL, NULL), ('click', 'GENERIC_TIMEOUT_LINE', 'GENERIC_PATTERN', 'WARNING', 'LOW', 'sdb', NULL), ('purchase', 'GENERIC_FAILURE_LINE', 'GENERIC_PATTERN', 'ERROR', 'LOW', NULL, 'DATA'),
 ('signup', 'TRACE_FILE_REFERENCE', 'GENERIC_PATTERN', 'WARNING', 'LOW', NULL, NULL)) g(event_type, code, code_type, severity, parse_confidence, device, diskgroup) USING (event_type),
 LATERAL (SELECT CASE WHEN event_type = 'signup' THEN '/u01/x_' || event_id || '.trc' END AS trace_file)""")
def generic_lines(spark, sf_dir):
    """P25: lines with a code or a telling word, but for logins."""
    line = by_type(
        text("sshd[1]: error in failed password"), error=text("x ORA-00600: internal and TNS-12541"), click=text("timeout on sdb after ", event_id()), purchase=text("mount failed for diskgroup DATA now"),
        signup=text("error noted in /u01/x_", event_id(), ".trc"),
    )
    out = P.generic_events(host_lines(spark, sf_dir, line))
    return out.select(F.col("source_path").alias("path"), long("line_number"), "code", "code_type", "severity", "parse_confidence", "device", "diskgroup", "trace_file")


# input detection, structured sources --------------------------------------------------------


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'LINUX' WHEN 'click' THEN 'AIX' WHEN 'signup' THEN 'EXADATA' WHEN 'purchase' THEN 'WINDOWS' ELSE 'UNKNOWN' END AS platform,
 CASE event_type WHEN 'error' THEN '5' WHEN 'purchase' THEN CAST(event_id AS VARCHAR) END AS errno, CASE event_type WHEN 'error' THEN 'Input/output error' WHEN 'purchase' THEN 'Access is denied.' END AS errno_text FROM events""")
def platform_detection(spark, sf_dir):
    """The platform that a text shows, and its error number."""
    content = by_type(
        text("plain"), error=text("Linux-x86_64 Error: 5: Input/output error"), click=text("LABEL: DISK_ERR7\nIDENTIFIER: X"), signup=text("cellDiskType: FlashDisk"), purchase=text("O/S-Error: (OS ", event_id(), ") Access is denied."),
    )
    rows = table(spark, sf_dir, "events").select("event_id", content.alias("text"))
    rows = rows.withColumn("platform", D.platform(F.col("text")))
    e = D.errno(F.col("text"), F.col("platform"))
    return rows.select("event_id", "platform", e["number"].alias("errno"), e["message"].alias("errno_text"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'ora_code' WHEN 'signup' THEN 'log_paste' ELSE 'natural_language' END AS mode, CASE event_type WHEN 'error' THEN 'ORA-00600' WHEN 'click' THEN 'ORA-01555' ELSE '' END AS primary_ora,
 CASE WHEN event_type IN ('click') THEN 'dbhost' || user_id WHEN event_type = 'signup' THEN 'db' || user_id ELSE '' END AS hostname,
 CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_type = 'signup' THEN strftime(ts, '%b %-d %H:%M:%S') ELSE '' END AS timestamp_str,
 CASE event_type WHEN 'error' THEN 'DB' WHEN 'click' THEN 'DB' WHEN 'signup' THEN 'OS' ELSE '' END AS observed_layers FROM events""")
def input_parsing(spark, sf_dir):
    """What kind of question a text is, and what it names."""
    content = by_type(
        text("why is everything slow"), error=text("ORA-00600 internal error"), click=text("what is ora-01555 on dbhost", user_id(), " at ", stamp("yyyy-MM-dd HH:mm:ss")), signup=text(stamp("MMM d HH:mm:ss"), " db", user_id(), " kernel: it broke"),
    )
    out = D.parse_input(table(spark, sf_dir, "events").select(event_id().alias("query_id"), content.alias("text")))
    return out.select(F.col("query_id").alias("event_id"), "mode", "primary_ora", "hostname", "timestamp_str", F.array_join("observed_layers", ",").alias("observed_layers"))


@query("""SELECT event_id, event_type IN ('error', 'click', 'signup') AS runs FROM events""")
def command_lines(spark, sf_dir):
    """Commands, and prose that only looks like them."""
    line = by_type(text("Please select a disk"), error=text("alter system set x=", event_id()), click=text("$ ls -l"), signup=text("x; select 1 from dual"), purchase=text("Cause: y\nAction: drop z"))
    return table(spark, sf_dir, "events").select("event_id", D.executable_command(line).alias("runs"))


@query("""SELECT CASE WHEN event_type IN ('error', 'click') THEN 'e' || event_id END AS wrapper, CASE event_type WHEN 'error' THEN 'inner' || user_id || '.log' WHEN 'click' THEN 'json_payload.log' ELSE 'e' || event_id END AS path,
 CASE event_type WHEN 'error' THEN 'ORA-00600 ' || event_id WHEN 'click' THEN 'line ' || event_id ELSE 'plain ' || event_id END AS text FROM events""")
def json_payloads(spark, sf_dir):
    """Wrapped logs come out, other texts stay."""
    content = by_type(text("plain ", event_id()), error=text('{"logs":[{"name":"inner', user_id(), '.log","text":"ORA-00600 ', event_id(), '"},{"name":"empty"}]}'), click=text('[{"content":"line ', event_id(), '"}]'))
    return S.json_logs(event_files(spark, sf_dir, content)).select("wrapper", "path", "text")


@query("""SELECT 'host' || user_id AS path, string_agg('# host=h' || user_id || CASE WHEN event_type = 'error' THEN ' source=s' ELSE '' END || chr(10) || props, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id""")
def json_headers(spark, sf_dir):
    """Items of a payload as one text with header lines."""
    rows = table(spark, sf_dir, "events").select(
        text("host", user_id()).alias("path"), event_id().alias("position"), text("h", user_id()).alias("hostname"), F.lit(None).cast("string").alias("timestamp"), F.when(event_type() == "error", "s").alias("source"), text("  ", F.col("props"), " ").alias("text")
    )
    return S.json_header_text(rows)


@query("""SELECT 'e' || event_id AS path, 'ORA-' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS code, 'something ' || event_type AS message, CASE WHEN event_type = 'error' THEN 'bad ' || user_id || ' luck' ELSE '' END AS cause, 'do it' AS action,
 CASE WHEN event_type = 'error' THEN 'bad ' || user_id || ' luck' ELSE 'something ' || event_type END AS meaning FROM events""")
def manual_sections(spark, sf_dir):
    """Code, message, cause and action of a manual's sections."""
    cause = F.when(event_type() == "error", text("Cause: bad ", user_id(), "\nluck\n")).otherwise("")
    content = text("preface\nORA-", F.lpad((event_id() % 100000).cast("string"), 5, "0"), ": something ", event_type(), "\n", cause, "*Action: do it\n")
    return S.manual_messages(event_lines(spark, sf_dir, content)).select("path", "code", "message", "cause", "action", "meaning")


@query("""SELECT 'e' || event_id AS path, CAST(3 AS BIGINT) AS line_number, 'ORA-' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS error_code, 'slow ' || event_type AS symptoms, 'first' || chr(10) || 'second' AS action_plan FROM events""")
def markdown_rows(spark, sf_dir):
    """Rows of a table of codes."""
    content = text("| code | symptom | plan |\n|---|---|---|\n| ORA-", F.lpad((event_id() % 100000).cast("string"), 5, "0"), " | slow ", event_type(), " | first<br/>second |\n| no code | x | y |\n| ORA-00001 | two cells |\n")
    return S.markdown_tables(event_lines(spark, sf_dir, content)).select("path", long("line_number"), "error_code", "symptoms", "action_plan")
