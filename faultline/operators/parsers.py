"""Log text to rows.  A parser takes lines (path, line_number, line) or whole
files (path, text) of many files at once and returns rows of all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.time import CLASSIC, MONTHS, classic_time, group, iso_time, line_time, short_time
from faultline.operators.events import conform
from faultline.operators.scan import nearby, scan_lines

# fixed values -----------------------------------------------------------------
RFC3164 = rf"^((?:{MONTHS})\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s*(.+)$"
RFC5424 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s+(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?:\s*(.+)$"
DMESG = r"^\[\s*([\d.]+)\]\s+(.+)$"
XML_TIME = r"<msg time='(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2})'"
ISO_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2})$"
ORA = r"(ORA-\d{5})"
CONTAINER = r"\[([A-Z][A-Z0-9_$#]{0,29})\]"
TRACE_FORMS = (r"Incident details in:\s*(.+?\.trc)", r"Errors in file (.+?\.trc)(?:\s+\(incident=\d+\))?(?::)?", r"(?:Dump file|Trace file):\s*(.+?\.trc)")
INCIDENT = r"(?:incident=|incdir_|_i)(\d{4,10})"
ERRNO = r"(Linux-x86_64|IBM AIX RISC System/6000|Solaris-\w+|HP-UX|O/S) Error: (\d+): (.+)"
PROCESS_DIED = r"(LGWR|DBWR|MMON|PMON|SMON|CKPT|ARC\d+|LREG|DIAG|DBRM).*process \d+ died"
INSTANCE = r"(Starting ORACLE instance|Shutting down instance|Instance terminated|ORACLE instance shut down|ORACLE instance started)"
CRITICAL_LAYERS = ("OS_TRIGGERED", "ASM", "STORAGE", "MEMORY", "CLUSTER")
TERMINATING = r"(?i)(LGWR|DBWR|CKPT|ARC\d+|SMON|PMON)\s*\(\s*ospid:\s*(\d+)\):\s*terminating\s+the\s+instance(?:\s+due\s+to\s+error\s+(\d+))?"
ORA_LINE = r"(?i)^(ORA-\d{5})\s*:\s*(.*)$"
ORA_00312 = r"(?i)ORA-00312:\s*online\s+log\s+(\d+)\s+thread\s+(\d+):\s*['\"]?(.*?)['\"]?\s*$"
ORA_00353 = r"(?i)ORA-00353:.*?block\s+(\d+)"
CORRUPTION_TIME = r"(?i)\btime\s+(\d{1,2}/\d{1,2}/\d{4}\s+\d{2}:\d{2}:\d{2})\b"
ROLES = {
    "ORA-27072": "DB_IO_SYMPTOM", "ORA-00312": "OBJECT_LOCATOR", "ORA-00353": "FATAL_DB_SYMPTOM", "ORA-15080": "ASM_CONSEQUENCE",
    "ORA-15081": "ASM_CONSEQUENCE", "ORA-15130": "ASM_CONSEQUENCE", "ORA-01017": "AUTHENTICATION_FAILURE", "ORA-00257": "ARCHIVER_STUCK",
    "ORA-00600": "INTERNAL_ERROR", "ORA-07445": "INTERNAL_ERROR",
}
#: pattern, code, severity: a row for each that a message matches
SYSLOG_SIGNALS = (
    (r"Abort command issued", "FC_HBA_ABORT", "WARNING"),
    (r"Adapter reset issued", "FC_HBA_RESET", "ERROR"),
    (r"lpfc.*link down", "FC_LINK_DOWN", "ERROR"),
    (r"hostbyte=DID_TIME_OUT|DRIVER_TIMEOUT", "SCSI_DISK_TIMEOUT", "CRITICAL"),
    (r"blk_update_request:.*I/O error", "OS_BLOCK_IO_ERROR", "ERROR"),
    (r"Buffer I/O error on dev", "OS_BLOCK_IO_ERROR", "ERROR"),
    (r"remaining active paths:\s*0|no active paths", "MULTIPATH_ALL_PATHS_DOWN", "CRITICAL"),
    (r"Failing path", "MULTIPATH_PATH_FAILED", "WARNING"),
    (r"rejecting I/O to offline device", "DEVICE_OFFLINE", "CRITICAL"),
    (r"EXT4-fs error|XFS.*I/O error", "FILESYSTEM_IO_ERROR", "ERROR"),
    (r"oom-killer|Out of memory", "OS_OOM_KILLER", "CRITICAL"),
    (r"No space left on device", "FILESYSTEM_FULL", "CRITICAL"),
)
READ_FAILED = r"(?i)Read Failed\.\s*group:(\d+)\s+disk:(\d+)\s+AU:(\d+)\s+offset:(\d+)\s+size:(\d+)"
DISMOUNTING = r"(?i)cache\s+dismounting\s+group\s+(\d+)(?:\s*\(([^)]+)\))?"
CELL_BODY = r"(?i)CELLSRV|\bMS:\s|\bRS:\s|flashdisk|griddisk|celldisk|warningCode="
CELL_LINE = r"(?i)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*(?:([-+]\d{2}:\d{2}|Z)\s+)?(?:(\S+)\s+)?(CELLSRV|MS|RS):\s*(.*)$"
CELL_BENIGN = r"(?i)no\s+flash\s+disk\s+alerts|no\s+alerts\s+in\s+this\s+interval|normal\s+operation|completed\s+successfully|no\s+errors\s+found"
CELL_REPLACE = r"(?i)requires\s+replacement|repeated\s+read\s+retries|Hardware\s+alert:|FD_\d+\s+on\s+CD_\d+\s+requires"
FLASH_CRITICAL = r"(?i)metricObjectName:\s*(FD_[^\s,]+).*metricValue:\s*critical|\bFD_\d+\s+critical\b|^MS:.*\bFD_\d+.*critical"
CRS_LINE = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+\[([^\]]+)\](CRS-\d+)?:?\s*(.+)$"
CRS_PATTERNS = {
    "CRS-1618": "BONDING_FAILOVER_EVENT", "CRS-1625": "BONDING_FAILOVER_EVENT", "CRS-1632": "BONDING_FAILOVER_EVENT", "CRS-5011": "NTP_TIME_JUMP",
    "CRS-1009": "CGROUP_OOM_KILL",
}
CRS_SEVERITY = {
    "CRS-1618": "CRITICAL", "CRS-1625": "CRITICAL", "CRS-1632": "CRITICAL", "CRS-5011": "CRITICAL", "CRS-1009": "CRITICAL", "CRS-2674": "ERROR",
    "CRS-2676": "INFO", "CRS-6011": "INFO",
}
CRS_EVICTIONS = ("CRS-1618", "CRS-1625", "CRS-1632", "CRS-2999", "CRS-5017")
CRS_BENIGN = ("CRS-2676", "CRS-6011", "CRS-2672", "CRS-5702", "CRS-0215", "CRS-2791")
AIX_SEVERITY = {"PERM": "CRITICAL", "TEMP": "ERROR", "PERF": "WARNING", "UNKN": "WARNING", "INFO": "INFO"}
AIX_PATTERNS = {
    "DISK_ERR7": "SCSI_DISK_TIMEOUT", "DISK_ERR1": "SCSI_DISK_TIMEOUT", "DISK_ERR6": "IO_QUEUE_TIMEOUT", "MPIO_PATH_ERR": "MULTIPATH_PATH_FAILED",
    "MPIO_PATH_DEGRADED": "MULTIPATH_DEGRADED", "MPIO_ALL_PATHS_DOWN": "MULTIPATH_ALL_PATHS_DOWN", "FS_FULL": "FILESYSTEM_ARCH_FULL",
    "FC_LINK_DOWN": "FC_HBA_RESET", "FC_PORT_LINK_DOWN": "FC_HBA_RESET", "MEM_EPOW": "ENVIRONMENTAL_POWER_WARNING",
    "LPAR_CAPACITY": "CPU_STEAL_TIME", "NET_ERR_FAIL": "BONDING_FAILOVER_EVENT", "NFS_ERR": "NFS_MOUNT_TIMEOUT",
}
AIX_CATEGORY = {"H": "DISK", "S": "MEMORY", "O": "KERNEL", "U": "KERNEL"}
WAITS = {
    "latch: shared pool": "SHARED_POOL_CONTENTION", "latch free": "LATCH_CONTENTION", "library cache lock": "PARSE_PRESSURE",
    "library cache: mutex x": "PARSE_PRESSURE", "cursor: pin s wait on x": "PARSE_PRESSURE", "cursor: mutex x": "PARSE_PRESSURE",
    "enq: tx - row lock contention": "ROW_LOCK_CONTENTION", "db file sequential read": "IO_SINGLE_BLOCK", "db file scattered read": "IO_MULTI_BLOCK",
    "log file sync": "REDO_LOG_PRESSURE", "log buffer space": "REDO_LOG_PRESSURE", "direct path read": "IO_DIRECT_PATH",
    "direct path write": "IO_DIRECT_PATH", "gc buffer busy acquire": "RAC_GC_CONTENTION", "gc cr request": "RAC_GC_CONTENTION",
    "resmgr:cpu quantum": "PDB_RESOURCE_THROTTLE", "resmgr:consume cpu time": "PDB_RESOURCE_THROTTLE",
}
WAIT_CLASSES = r"User I/O|System I/O|Commit|Concurrency|Cluster|Application|Configuration|Administrative|Network|Other|Idle|Scheduler|Queueing"
WAIT_SECTIONS = (
    r"(?is)(Top\s+\d+\s+Foreground\s+Events\s+by\s+Total\s+Wait\s+Time.{0,3000})", r"(?is)(Top\s+\d+\s+Timed\s+Events.{0,3000})",
    r"(?is)(Top\s+\d+\s+Foreground\s+Events.{0,3000})", r"(?is)(Top\s+\d+\s+Events\s+by\s+Total\s+Wait\s+Time.{0,3000})",
)
TRACE_HEADER = {
    "oracle_version": r"Oracle Database (.*) Release", "db_name": r"DB Name:\s*([A-Za-z0-9_$#]+)", "instance_name": r"Instance name:\s*([A-Za-z0-9_$#]+)",
    "pid": r"Process ID:\s*([0-9]+)", "sid": r"Session ID:\s*([0-9]+)", "serial": r"Serial #:\s*([0-9]+)", "pname": r"Process name:\s*([A-Za-z0-9_]+)",
}
#: start marker, end marker, most lines
TRACE_SECTIONS = {
    "call_stack": ("----- Call Stack -----", "----------------------", 50),
    "error_stack": ("----- Error Stack -----", "-----------------------", 30),
    "binary_info": ("----- Binary Info -----", "-----------------------", 10),
}
STACK_HIGHLIGHTS = ("kcf", "ksedmp", "kjz")
SECURITY = (
    ("ssh_failed", r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+) ssh2", "WARNING"),
    ("ssh_accepted", r"Accepted password for (\S+) from (\S+) port (\d+) ssh2", "INFO"),
    ("sudo_exec", r"sudo:\s+(\S+) : TTY=\S+ ; PWD=\S+ ; USER=\S+ ; COMMAND=(.+)", "INFO"),
    ("auth_failure", r"authentication failure; logname=\S* uid=\d+ euid=\d+ tty=\S+ ruser=\S* rhost=(\S*)", "ERROR"),
)
AUDIT_FIELDS = ("action", "userid", "terminal", "returncode", "db_user")
GENERIC_WORDS = ("error", "failed", "failure", "timeout", "i/o", "offline", "kernel", "multipath")
AUTH_LINE = r"(?i)\bsshd\b|\bsudo(?:\[|\b)|failed\s+password|authentication\s+failure|invalid\s+user"
# -----------------------------------------------------------------------------


def lookup(column: Column, values: dict, default=None) -> Column:
    """A fixed table as an expression."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)
    return F.when(column.isNull(), F.lit(default)).otherwise(F.coalesce(out, F.lit(default)))


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later steps read often.  A generator of one row
    keeps the optimizer from copying a large expression to each of them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_number from 1, line, n_lines of the file)."""
    # whole texts are dealt by path once, so windows and groups of their lines need no exchange of lines; a
    # number of parts keeps adaptive execution from joining parts by the size of texts, as lines take more
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = files.select("path", "text").repartition(parts, "path").select("path", F.split("text", r"\r?\n").alias("_lines")).withColumn("n_lines", F.size("_lines"))
    exploded = cut.select("path", "n_lines", F.posexplode("_lines").alias("_pos", "line"))
    return exploded.select("path", (F.col("_pos") + 1).alias("line_number"), "line", "n_lines")


def blocks(lines: DataFrame, header: Column, keep_head: bool = False) -> DataFrame:
    """Numbers the blocks that header lines open.  Lines before the
    first header are block 0 and go unless ``keep_head``."""
    out = scan_lines(lines.withColumn("header", header), counts={"block": F.col("header").cast("int")})
    return out if keep_head else out.where("block > 0")


def gathered(rows: DataFrame, value: str, keys: list[str] | None = None) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("line_number", value))), lambda x: x[value])


# syslog ------------------------------------------------------------------------


def _no_newline(line: Column) -> Column:
    return F.when(line.contains("\n"), F.regexp_replace(line, r"\n$", "")).otherwise(line)


def _syslog_groups(s: Column) -> Column:
    """The parts of a line in the first of three formats, null if none matches.
    Of a match only the pid may be empty."""
    g = lambda p, n: F.regexp_extract(s, p, n)
    none = F.lit(None).cast("string")
    struct = lambda text, host, process, pid, message, form: F.struct(
        text.alias("raw"), host.alias("host"), process.alias("process"), pid.alias("pid"), message.alias("message"), F.lit(form).alias("format")
    )
    full = lambda p, form: F.when(s.rlike(p), struct(g(p, 1), g(p, 2), g(p, 3), group(s, p, 4), g(p, 5), form))
    return F.coalesce(full(RFC3164, "RFC3164"), full(RFC5424, "RFC5424"), F.when(s.rlike(DMESG), struct(F.concat(F.lit("["), g(DMESG, 1), F.lit("]")), none, F.lit("kernel"), none, g(DMESG, 2), "DMESG")))


def _syslog_dated(parts: Column, year: Column) -> Column:
    """Parts with their time.  A time without year is known to be one, so no
    other form is tried."""
    form, raw = parts["format"], parts["raw"]
    short, full = form == "RFC3164", form == "RFC5424"
    sure = F.when(short & year.isNotNull(), "MEDIUM").when(full & iso_time(raw).isNotNull(), "HIGH").otherwise("LOW")
    out = F.struct(
        F.when(short, short_time(raw, year)).when(full, iso_time(raw)).alias("timestamp"), raw.alias("timestamp_raw"), sure.alias("timestamp_confidence"), parts["host"].alias("host"),
        parts["process"].alias("process"), parts["pid"].alias("pid"), parts["message"].alias("message"), form.alias("format"),
    )
    return F.when(parts.isNotNull(), out)


def syslog_fields(line: Column, year: Column | None = None) -> Column:
    """One struct for the first of three formats, null if none matches."""
    year = F.lit(None).cast("int") if year is None else year
    # functions of an array's element, so that the parts are taken once
    parts = F.transform(F.array(_no_newline(line)), _syslog_groups)
    return F.transform(parts, lambda p: _syslog_dated(p, year))[0]


def syslog_header(line: Column) -> Column:
    """Whether ``syslog_fields`` finds an entry in a line."""
    s = _no_newline(line)
    return F.coalesce(s.rlike(RFC3164) | s.rlike(RFC5424) | s.rlike(DMESG), F.lit(False))


def parse_syslog(lines: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Entries with their continuation lines, the trailing ones too.

    Lines are only told apart where they are scanned and grouped; the fields
    are taken from the first line of an entry afterwards, once, in small steps
    (one large expression of regexes isn't compiled by the JVM).
    """
    grouped = blocks(lines.where(F.trim("line") != ""), syslog_header(F.col("line")))
    whole = grouped.groupBy("path", "block").agg(F.min("line_number").alias("line_number"), gathered(grouped, "line").alias("_lines"))
    first = computed(whole, "_first", _no_newline(F.col("_lines")[0]))
    whole = computed(first, "_parts", _syslog_groups(F.col("_first")))
    dated = whole.join(years, "path", "left") if years is not None else whole.withColumn("year", F.lit(None).cast("int"))
    out = computed(dated, "f", _syslog_dated(F.col("_parts"), F.col("year")))
    more = F.transform(F.slice("_lines", F.lit(2), F.size("_lines")), lambda x: F.trim(x))
    message = F.array_join(F.concat(F.array("f.message"), more), " ")
    return out.select("path", "line_number", "f.timestamp", "f.timestamp_raw", "f.timestamp_confidence", "f.host", "f.process", "f.pid", message.alias("message"), F.array_join("_lines", "\n").alias("raw"), "f.format")


def syslog_events(entries: DataFrame) -> DataFrame:
    """A normalized event for each signal that a message shows."""
    rules = F.array(*[F.when(F.col("message").rlike(f"(?i){p}"), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(k).alias("rule"))) for k, (p, code, sev) in enumerate(SYSLOG_SIGNALS)])
    hits = entries.withColumn("_hit", F.explode(F.array_compact(rules))).drop("severity")
    rows = hits.select(
        "timestamp", "timestamp_raw", "timestamp_confidence", F.col("path").alias("source_path"), F.lit("syslog").alias("source_type"), "line_number", "host",
        F.lit("OS").alias("layer"), F.col("process").alias("component"), "process", "pid", F.col("_hit.code").alias("code"), F.lit("OS_PATTERN").alias("code_type"),
        "message", F.col("_hit.severity").alias("severity"), F.lit("IO").alias("failure_family"), group(F.col("message"), r"(?i)\b(sd[a-z]+|dm-\d+)\b").alias("device"),
        group(F.col("message"), r"(?i)\b(mpath[a-z0-9_]+)\b").alias("multipath_device"), group(F.col("message"), r"(?i)sector\s+(\d+)").alias("block"), "raw",
        F.lit("HIGH").alias("parse_confidence"), F.array(F.lit("SYSLOG_LINE")).alias("tags"),
    )
    return conform(rows, "syslog_parser")


# alert log ---------------------------------------------------------------------


def alert_header(line: Column) -> Column:
    s = F.trim(line)
    return F.coalesce(
        F.when(s.rlike(CLASSIC), classic_time(s)), F.when(line.rlike(XML_TIME), iso_time(F.regexp_extract(line, XML_TIME, 1))), F.when(s.rlike(ISO_LINE), iso_time(s))
    )


def truncate_dumps(lines: DataFrame, most: int = 5) -> DataFrame:
    """P5: of the lines after an SQL statement marker ``most`` stay, then one
    marker, until a blank or an error line ends the dump."""
    marker = F.col("line").contains("SQL statement") | F.col("line").contains("Current SQL")
    ends = (F.trim("line") == "") | F.col("line").startswith("ORA-") | F.col("line").startswith("Errors in file")
    state = scan_lines(lines, {"_state": F.when(marker, F.col("line_number")).when(ends, F.lit(0))})
    after = F.col("line_number") - F.col("_state")
    inside = F.coalesce(F.col("_state") > 0, F.lit(False))
    cut = state.where(~inside | (after <= most + 1))
    return cut.withColumn("line", F.when(inside & (after == most + 1), F.lit("... [SQL DUMP TRUNCATED] ...")).otherwise(F.col("line"))).drop("_state")


def parse_alert_blocks(lines: DataFrame, critical_codes: list[str] | None = None) -> DataFrame:
    """One row a timestamped block."""
    with_time = computed(truncate_dumps(lines), "ts", alert_header(F.col("line")))
    grouped = blocks(with_time, F.col("ts").isNotNull())
    rows = grouped.groupBy("path", "block").agg(
        F.min("line_number").alias("line_number"), F.min("ts").alias("timestamp"), F.min_by(F.trim("line"), "line_number").alias("timestamp_raw"), gathered(grouped, "line").alias("lines")
    )
    rows = rows.withColumn("raw", F.array_join("lines", "\n"))
    text = F.col("raw")
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(ORA)))
    trace = F.trim(F.coalesce(*[group(text, p) for p in TRACE_FORMS]))
    container = group(text, CONTAINER)
    died = group(text, PROCESS_DIED)
    # codes starting ORA-15 are the storage manager's; others as the caller says
    serious = F.exists("ora_codes", lambda c: c.startswith("ORA-15") | c.isin(list(critical_codes or ())))
    return rows.withColumn("ora_codes", codes).select(
        "path", "block", "line_number", "timestamp", "timestamp_raw", "ora_codes", group(text, ERRNO, 2).alias("errno"), group(text, ERRNO, 3).alias("errno_text"),
        trace.alias("trace_path"), F.regexp_replace(trace, r"/[^/]*$", "").alias("incident_path"), group(text, INCIDENT).alias("incident_id"),
        F.when(container == "ROOT", "CDB$ROOT").when(container != "SEED", container).alias("pdb_name"), died.alias("process_died"), group(text, INSTANCE).alias("instance_message"),
        F.when(F.size("ora_codes") > 0, F.when(serious, "CRITICAL").otherwise("ERROR")).when(died.isNotNull(), "CRITICAL").otherwise("INFO").alias("severity"),
        "lines", "raw",
    )


def alert_events(lines: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """An event for each telling line, with the time carried forward
    from the last line that has one of its own."""
    dated = lines.join(years, "path", "left") if years is not None else lines.withColumn("year", F.lit(None).cast("int"))
    rows = computed(dated.withColumn("s", F.trim("line")), "t", line_time(F.col("s"), F.col("year")))
    embedded = F.col("s").rlike(r"(?i)^ORA-\d{5}\b") & ((F.instr(F.col("s"), F.coalesce(F.col("t.raw"), F.lit("\0"))) > 13) | F.col("s").rlike(CORRUPTION_TIME))
    own = F.when(F.col("t.ts").isNotNull() & ~embedded, F.col("t"))
    errno = F.when(F.col("line").rlike(ERRNO), F.struct(F.regexp_extract("line", ERRNO, 2).alias("n"), F.regexp_extract("line", ERRNO, 3).alias("text")))
    rows = scan_lines(nearby(rows.withColumn("errno", errno), 5, 2, {"near_errno": F.col("errno")}), {"now": own})
    s = F.col("s")
    code = F.upper(F.regexp_extract(s, ORA_LINE, 1))
    kind = (
        F.when(s.rlike(TERMINATING), "end").when(s.rlike(ORA_00312), "312").when(s.rlike(ORA_00353), "353")
        .when(s.rlike(ERRNO) & ~F.substring(s, 1, 20).contains("ORA-"), "errno").when(s.rlike(ORA_LINE), "ora")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("ora", code)
    k = F.col("kind")
    due = group(s, TERMINATING, 3)
    asm = F.col("ora").startswith("ORA-15")
    pick = lambda **by: reduce(lambda acc, kv: acc.when(k == kv[0].lstrip("_"), kv[1]), list(by.items())[1:], F.when(k == list(by)[0].lstrip("_"), list(by.values())[0]))
    io = (k == "ora") & (F.col("ora") == "ORA-27072")
    out = rows.select(
        "line_number", F.col("path").alias("source_path"), F.lit("alert_log").alias("source_type"), F.col("now.ts").alias("timestamp"), F.col("now.raw").alias("timestamp_raw"),
        F.coalesce("now.confidence", F.lit("LOW")).alias("timestamp_confidence"),
        F.when(k == "errno", "OS").when((k == "ora") & asm, "ASM").otherwise("DB").alias("layer"),
        group(s, TERMINATING, 1).alias("process"), group(s, TERMINATING, 2).alias("pid"),
        pick(end=F.lit("LGWR_INSTANCE_TERMINATION"), _312=F.lit("ORA-00312"), _353=F.lit("ORA-00353"), errno=F.concat(F.lit("OS_ERRNO_"), F.col("errno.n")), ora=F.col("ora")).alias("code"),
        F.when(k == "end", "PROCESS_EVENT").when(k == "errno", "OS_PATTERN").otherwise("ORA").alias("code_type"),
        F.when(due.isNotNull(), F.concat(F.lit("ORA-"), F.lpad(due, 5, "0"))).alias("mapped_code_hint"),
        pick(end=F.lit("FINAL_IMPACT"), _312=F.lit(ROLES["ORA-00312"]), _353=F.lit(ROLES["ORA-00353"]), ora=lookup(F.col("ora"), ROLES)).alias("role_hint"),
        F.when(k.isin("end", "353") | ((k == "ora") & F.col("ora").isin("ORA-00353", "ORA-00600", "ORA-07445")), "CRITICAL").otherwise("ERROR").alias("severity"),
        pick(end=F.lit("INSTANCE_TERMINATION"), _312=F.lit("REDO"), _353=F.lit("REDO_CORRUPTION"), errno=F.lit("IO"), ora=F.when(io, "IO").when(asm, "ASM").otherwise("DB")).alias("failure_family"),
        F.when(k == "ora", F.trim(F.regexp_extract(s, ORA_LINE, 2))).otherwise(s).alias("message"),
        F.when(k == "312", group(s, ORA_00312, 1)).alias("redo_group"), F.when(k == "312", group(s, ORA_00312, 2)).alias("redo_thread"), F.when(k == "312", F.trim(F.regexp_extract(s, ORA_00312, 3))).alias("file_path"),
        F.when(k == "353", group(s, ORA_00353, 1)).alias("block"),
        F.when(k == "errno", F.col("errno.n")).when(io, F.col("near_errno.n")).alias("os_errno"),
        F.substring(F.trim(F.when(k == "errno", F.col("errno.text")).when(io, F.col("near_errno.text"))), 1, 500).alias("linux_error"),
        F.when((k == "353") & s.rlike(CORRUPTION_TIME), F.create_map(F.lit("corruption_time"), F.regexp_extract(s, CORRUPTION_TIME, 1))).alias("details"),
        F.when(k == "end", F.array(F.lit("ALERT_LOG"), F.lit("NON_ORA"))).when(k == "errno", F.array(F.lit("ALERT_LOG"), F.lit("LINUX_ERRNO"))).otherwise(F.array(F.lit("ALERT_LOG"))).alias("tags"),
        F.lit("HIGH").alias("parse_confidence"), s.alias("raw"),
    )
    return conform(out, "alert_log_parser")


def asm_events(lines: DataFrame) -> DataFrame:
    """Storage-manager fragments; several of one line are several events."""
    s = F.trim("line")
    rows = lines.where((s != "") & ~F.col("line").rlike(CELL_BODY)).withColumn("s", s)
    g = lambda p, n: group(F.col("s"), p, n)
    base = lambda code, kind, severity, tag: [F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.lit(kind).alias("code_type"), F.lit(severity).alias("severity"), F.array(F.lit(tag)).alias("tags")]
    common = ["line_number", F.col("path").alias("source_path"), F.lit("asm_log").alias("source_type"), F.lit("ASM").alias("layer"), F.col("s").alias("message"), F.col("s").alias("raw")]
    failed = rows.where(F.col("s").rlike(READ_FAILED)).select(
        *common, *base("ASM_READ_FAILED", "ASM_PATTERN", "CRITICAL", "ASM_COORD"), g(READ_FAILED, 1).alias("asm_group"), g(READ_FAILED, 2).alias("asm_disk"), g(READ_FAILED, 3).alias("au"),
        g(READ_FAILED, 4).alias("offset"), g(READ_FAILED, 5).alias("size"), F.lit("IO").alias("failure_family"), F.lit("HIGH").alias("parse_confidence"),
    )
    leaving = rows.where(F.col("s").rlike(DISMOUNTING)).select(*common, *base("ASM_DISMOUNT_PROGRESS", "ASM_PATTERN", "WARNING", "ASM_DISMOUNT"), g(DISMOUNTING, 1).alias("asm_group"), g(DISMOUNTING, 2).alias("diskgroup"))
    codes = rows.withColumn("_code", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(r"(?i)\b(ORA-15\d{3})\b")), F.upper))))
    # an alert line that starts with the code has its event already
    codes = codes.where(~(F.upper(F.regexp_extract("s", ORA_LINE, 1)) == F.col("_code"))).select(*common, *base(F.col("_code"), "ORA", "ERROR", "ASM_ORA"))
    return conform(failed.unionByName(leaving, True).unionByName(codes, True), "asm_snippet_parser")


# storage cells, cluster, AIX ------------------------------------------------------


def cell_events(lines: DataFrame, cell_name: str = "unknown") -> DataFrame:
    """Cell log entries with their continuation lines."""
    rows = lines.withColumn("s", F.trim("line"))
    grouped = blocks(rows, F.col("s").rlike(CELL_LINE))
    found = grouped.groupBy("path", "block").agg(F.min("line_number").alias("line_number"), F.min_by("s", "line_number").alias("head"), gathered(grouped, "line").alias("all"), gathered(grouped, "s").alias("texts"))
    g = lambda n: group(F.col("head"), CELL_LINE, n)
    found = found.withColumn("rest", F.coalesce(g(5), F.lit(""))).withColumn("whole", F.array_join("texts", "\n"))
    rest = F.col("rest")
    has = lambda p: rest.rlike(p)
    warning = group(rest, r"(?i)warningCode=(\w+)")
    media = has(r"(?i)media read retries exhausted for\s+(\S+)")
    code = (
        F.when(has(READ_FAILED), "STORAGE_ASM_READ_FAILED").when(media, "STORAGE_MEDIA_READ_FAILURE").when(has(r"(?i)flashcache\s+read\s+error"), "FLASH_CACHE_READ_ERROR")
        .when(has(FLASH_CRITICAL), "FLASH_DISK_CRITICAL").when(has(r"(?i)\bIORM\b.*throttl|backend\s+latency\s+spike"), "STORAGE_BACKEND_LATENCY")
        .when(warning.isNotNull(), warning).when(has(CELL_BENIGN), F.lit(None)).when(has(CELL_REPLACE), "STORAGE_MEDIA_READ_FAILURE").otherwise("CELL_INFORMATIONAL")
    )
    found = found.withColumn("code", code).where("code is not null")
    c = F.col("code")
    severity = (
        F.when((c == "FLASH_DISK_CRITICAL") | media | F.upper(c).contains("TIMEOUT"), "CRITICAL").when((c == "STORAGE_MEDIA_READ_FAILURE") & has(CELL_REPLACE), "CRITICAL")
        .when(c == "CELL_INFORMATIONAL", "INFO").otherwise("ERROR")
    )
    at = F.concat(g(1), F.coalesce(g(2), F.lit("")))
    cell = F.coalesce(g(3), F.lit(cell_name))
    whole = F.col("whole")
    out = found.select(
        "line_number", F.col("path").alias("source_path"), F.lit("cell_log").alias("source_type"), iso_time(at).alias("timestamp"), F.concat_ws(" ", g(1), g(2)).alias("timestamp_raw"),
        F.when(iso_time(at).isNotNull(), "HIGH").otherwise("LOW").alias("timestamp_confidence"), cell.alias("host"), cell.alias("cell"), F.upper(g(4)).alias("component"), F.lit("STORAGE").alias("layer"),
        "code", F.lit("STORAGE_PATTERN").alias("code_type"), severity.alias("severity"), F.lit("IO").alias("failure_family"), F.concat_ws(" ", rest, F.array_join(F.slice("texts", 2, 10_000), " ")).alias("message"),
        group(rest, r"(?i)(?:flashDisk=|metricObjectName:\s*)(FD_[^,\s]+)").alias("flash_disk"), group(rest, r"(?i)cellDisk=(CD_[^,\s]+)").alias("cell_disk"),
        F.coalesce(group(rest, r"(?i)(?:at\s+)?griddisk\s+(\S+)"), group(rest, r"(?i)\b(DATA_CD_[^,\s]+)\b")).alias("grid_disk"),
        *[group(whole, READ_FAILED, n).alias(name) for n, name in enumerate(("asm_group", "asm_disk", "au", "offset", "size"), 1)],
        F.lit("HIGH").alias("parse_confidence"), F.array(F.lit("CELL_LOG")).alias("tags"), F.array_join("all", "\n").alias("raw"),
    )
    return conform(out, "cell_log_parser")


def parse_crs(lines: DataFrame) -> DataFrame:
    """Cluster log lines."""
    s = F.trim("line")
    g = lambda n: group(s, CRS_LINE, n)
    rows = lines.where(s.rlike(CRS_LINE)).select("path", "line_number", g(1).alias("timestamp_raw"), g(2).alias("component"), F.coalesce(g(3), group(g(4), r"(CRS-\d+)")).alias("crs_code"), g(4).alias("message"), s.alias("raw"))
    code = F.col("crs_code")
    return rows.select(
        "*", iso_time(F.col("timestamp_raw")).alias("timestamp"), lookup(code, CRS_SEVERITY, "ERROR").alias("severity"), lookup(code, CRS_PATTERNS).alias("os_pattern"),
        F.coalesce(code.isin(*CRS_EVICTIONS), F.lit(False)).alias("is_eviction"), F.coalesce(code.isin(*CRS_BENIGN), F.lit(False)).alias("is_false_positive"),
        group(F.col("message"), r"[Nn]ode (\S+)\s+(?:is|being|has)").alias("affected_node"), group(F.col("message"), r"resource '([^']+)'").alias("resource_name"),
    )


def crs_events(lines: DataFrame) -> DataFrame:
    rows = parse_crs(lines).where("not is_false_positive")
    return conform(
        rows.select(
            "line_number", "timestamp", "timestamp_raw", F.col("path").alias("source_path"), F.lit("crs_log").alias("source_type"), F.lit("CRS").alias("layer"), "component",
            F.coalesce("crs_code", F.lit("")).alias("code"), F.lit("CRS_PATTERN").alias("code_type"), "message", "severity", F.col("affected_node").alias("host"),
            F.col("resource_name").alias("crs_resource"), F.lit("HIGH").alias("parse_confidence"), F.array(F.lit("CRS_LOG")).alias("tags"), "raw",
        ), "crs_parser")


def parse_records(lines: DataFrame) -> DataFrame:
    """``key: value`` records that blank lines separate."""
    rows = scan_lines(lines, counts={"record": (F.trim("line") == "").cast("int")}).where(F.col("line").rlike(r"^\s*\w[\w ]*:\s*\S"))
    pair = F.struct(F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1)).alias("value"))
    rows = rows.withColumn("_pair", pair)
    once = rows.groupBy("path", "record", "_pair.key").agg(F.max_by("_pair.value", "line_number").alias("value"), F.min("line_number").alias("line_number"))
    return once.groupBy("path", "record").agg(F.min("line_number").alias("line_number"), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))


def parse_errpt(files: DataFrame) -> DataFrame:
    """AIX error reports, split at dashed lines."""
    entries = files.select("path", F.posexplode(F.split("text", r"(?m)^-{10,}$")).alias("entry", "raw"))
    field = lambda p: F.trim(group(F.col("raw"), p))
    rows = entries.select(
        "path", (F.col("entry") + 1).alias("line_number"), field(r"(?m)^LABEL:\s+(.+)$").alias("label"), field(r"(?m)^IDENTIFIER:\s+([0-9A-F]+)$").alias("identifier"),
        field(r"(?m)^Date/Time:\s+(.+)$").alias("timestamp_raw"), field(r"(?m)^Node Id:\s+(.+)$").alias("hostname"), field(r"(?m)^Class:\s+(.+)$").alias("aix_class"),
        field(r"(?m)^Type:\s+(.+)$").alias("aix_type"), field(r"(?m)^Resource Name:\s+(.+)$").alias("resource"), field(r"(?m)^Description\s*\n(.+)$").alias("description"), F.trim("raw").alias("raw"),
    ).where("label is not null")
    plain = F.regexp_replace("timestamp_raw", r"\s+[A-Z]{2,4}\s+", " ")
    return rows.select(
        "*", classic_time(plain).alias("timestamp"), lookup(F.col("aix_type"), AIX_SEVERITY, "ERROR").alias("severity"), lookup(F.col("label"), AIX_PATTERNS).alias("os_pattern"),
        lookup(F.col("aix_class"), AIX_CATEGORY, "DISK").alias("category"),
    )


# metrics --------------------------------------------------------------------------


def _numbers(s: Column) -> Column:
    return F.split(F.trim(s), r"\s+")


def parse_iostat(lines: DataFrame) -> DataFrame:
    """Device rows; the last header says which columns they have."""
    s = F.trim("line")
    old, new = s.rlike(r"(?i)Device[:\s]+rrqm.*avgrq.*await.*%util"), s.rlike(r"(?i)Device\s+r/s\s+w/s\s+rkB/s\s+wkB/s.*r_await")
    rows = scan_lines(lines, {"mode": F.when(old, "legacy").when(new, "modern")}).where(~old & ~new & (s != ""))
    rows = rows.withColumn("s", F.trim("line")).withColumn("v", _numbers(F.col("line"))).withColumn("n", F.size("v"))
    numeric = F.forall(F.slice("v", 2, 100), lambda x: x.rlike(r"^[\d.]+$"))
    num = lambda i: F.expr(f"try_cast(try_element_at(v, {i}) AS DOUBLE)")
    last = F.expr("try_cast(element_at(v, -1) AS DOUBLE)")
    legacy, modern = (F.col("mode") == "legacy") & numeric & (F.col("n") >= 14), (F.col("mode") == "modern") & numeric & F.col("n").between(13, 17)
    simple = (F.col("mode") == "legacy") & numeric & F.col("n").between(6, 13)
    pick = lambda a, b, c=0.0: F.when(legacy, a).when(modern, b).otherwise(F.lit(c) if isinstance(c, float) else c)
    out = rows.where(legacy | modern | simple).select(
        "path", "line_number", F.element_at("v", 1).alias("device"), pick(num(10), F.greatest(num(10), num(11))).alias("await_ms"), pick(num(11), num(10)).alias("r_await"),
        pick(num(12), num(11)).alias("w_await"), pick(num(14), last).alias("util_pct"), pick(num(4) + num(5), num(2) + num(3), num(2)).alias("iops"), F.col("s").alias("raw"),
    )
    u, a = F.col("util_pct"), F.col("await_ms")
    return out.withColumn("severity", F.when(u >= 95, "CRITICAL").when((u >= 80) | (a >= 200), "ERROR").when(a >= 100, "WARNING").otherwise("INFO"))


VMSTAT = ("r", "b", "swpd", "free", "buff", "cache", "si", "so", "bi", "bo", "in", "cs", "us", "sy", "id", "wa")


def vmstat_rows(lines: DataFrame, exact: bool = False) -> DataFrame:
    """Rows of 16 numbers or more; ``exact``: of 16 or 17 and nothing else."""
    end = r"(?:\s+\d+)?\s*$" if exact else r"(?:\s.*)?$"
    rows = lines.where(F.col("line").rlike(r"^\s*\d+(?:\s+\d+){15}" + end)).withColumn("v", _numbers(F.col("line")))
    return rows.select("path", "line_number", *[F.element_at("v", k).cast("bigint").alias(c) for k, c in enumerate(VMSTAT, 1)], F.trim("line").alias("raw"))


def parse_vmstat(lines: DataFrame) -> DataFrame:
    """P16"""
    swap, wait, queue = (F.col("si") > 500) | (F.col("so") > 500), F.col("wa") > 30, F.col("r") > 8
    patterns = F.array_compact(F.array(F.when(swap, "MEMORY_SWAP_STORM"), F.when(wait, "IO_QUEUE_TIMEOUT"), F.when(queue, "CPU_RUNQUEUE_SATURATION")))
    return vmstat_rows(lines).select("path", "line_number", "si", "so", "wa", "r", F.col("free").alias("free_kb"), F.col("swpd").alias("swpd_kb"), F.when(swap, "CRITICAL").when(wait, "ERROR").otherwise("INFO").alias("severity"), patterns.alias("patterns"), "raw")


def parse_df(lines: DataFrame) -> DataFrame:
    """P17"""
    p = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)%\s+(\S+)$"
    s = F.trim("line")
    rows = lines.where(s.rlike(p)).select("path", "line_number", *[F.regexp_extract(s, p, k).alias(c) for k, c in enumerate(("filesystem", "size", "used", "avail", "use_pct", "mount"), 1)], s.alias("raw"))
    rows = rows.where(~F.col("filesystem").rlike("(?i)tmpfs|devtmpfs|udev|none|overlay|squashfs")).withColumn("use_pct", F.col("use_pct").cast("int"))
    use = F.col("use_pct")
    pattern = F.when(use >= 100, F.when(F.lower("mount").contains("arch"), "FILESYSTEM_ARCH_FULL").otherwise("FILESYSTEM_ANY_FULL")).when(use >= 95, "FILESYSTEM_ANY_FULL")
    return rows.withColumn("severity", F.when(use >= 100, "CRITICAL").when(use >= 95, "ERROR").when(use >= 85, "WARNING").otherwise("INFO")).withColumn("os_pattern", pattern)


def parse_sar_cpu(lines: DataFrame) -> DataFrame:
    """P18"""
    p = r"^(\d{2}:\d{2}:\d{2})\s+(?:AM|PM)?\s*(\S+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
    s = F.trim("line")
    rows = lines.where(s.rlike(p) & (F.regexp_extract(s, p, 2) == "all"))
    rows = rows.select("path", "line_number", F.regexp_extract(s, p, 1).alias("time"), *[F.regexp_extract(s, p, k).cast("double").alias(c) for k, c in ((3, "user"), (6, "iowait"), (7, "steal"), (8, "idle"))], s.alias("raw"))
    steal, idle = F.col("steal") > 20, F.col("idle") < 5
    return rows.withColumn("severity", F.when(idle, "CRITICAL").when(steal, "ERROR").otherwise("INFO")).withColumn("patterns", F.array_compact(F.array(F.when(steal, "CPU_STEAL_TIME"), F.when(idle, "CPU_RUNQUEUE_SATURATION"))))


def parse_osw(lines: DataFrame, cpu_count: int = 4) -> DataFrame:
    """Peaks of each file's samples and the signals they give."""
    peaks = vmstat_rows(lines, exact=True).groupBy("path").agg(
        F.max("r").alias("peak_run_queue"), F.max("b").alias("peak_blocked"), F.max("si").alias("peak_swap_in"), F.max("so").alias("peak_swap_out"), F.min("free").alias("min_free_mem_kb"),
        F.max("wa").alias("peak_iowait_pct"), F.max("us").alias("peak_user_cpu_pct"), F.max("swpd").alias("peak_swpd_kb"), F.count("*").alias("sample_count"),
    )
    signals = F.array_compact(F.array(
        F.when(F.col("peak_run_queue") > 2 * cpu_count, "CPU_SATURATION"), F.when(F.col("peak_blocked") > 0, "PROCESS_D_STATE_ZOMBIE"),
        F.when((F.col("peak_swap_in") > 200) | (F.col("peak_swap_out") > 200), "MEMORY_PRESSURE"), F.when(F.col("min_free_mem_kb") < 524288, "LOW_PHYSICAL_MEMORY"),
        F.when(F.col("peak_iowait_pct") > 20, "IO_WAIT_HIGH"), F.when(F.col("peak_user_cpu_pct") > 80, "CPU_USER_HIGH"),
    ))
    return peaks.withColumn("osw_signals", signals)


def _names(wait: str):
    return lambda e: F.lower(e["event"]).contains(wait)


def parse_awr(files: DataFrame) -> DataFrame:
    """P20: load, wait events, memory and top statements of a report."""
    t = F.col("text")
    number = lambda p: F.regexp_replace(group(t, p), ",", "").try_cast("double")
    rows = files.select(
        "path", "text", number(r"(?i)Elapsed[:\s]+([0-9,]+\.?[0-9]*)\s*\(mins\)").alias("elapsed_mins"), number(r"(?i)DB\s*Time[:\s]+([0-9,]+\.?[0-9]*)\s*\(mins\)").alias("db_time_mins"),
        F.coalesce(*[group(t, p) for p in WAIT_SECTIONS], F.lit("")).alias("_waits"), group(t, r"(?is)(SQL\s+ordered\s+by\s+Elapsed\s+Time.{0,3970})").alias("_sql"),
        number(r"(?i)SGA\s+(?:use|size|target)[^\n]*?([0-9,]+\.?\d*)\s*M?B?").alias("sga_total_mb"), number(r"(?i)PGA\s+(?:use|size|target|aggregate)[^\n]*?([0-9,]+\.?\d*)\s*M?B?").alias("pga_total_mb"),
        number(r"(?i)shared\s+pool\s+free[^\n]*?([0-9]+\.?\d*)\s*%?").alias("shared_pool_free_pct"),
    )
    line = rf"^([a-zA-Z][a-zA-Z0-9 :_/\-.]+?)\s{{2,}}([\d,]+)\s+([\d,]+\.?\d*)\s+[\d,]+\.?\d*\s+([\d,]+\.?\d*)\s+({WAIT_CLASSES})\s*$"
    events = F.transform(F.filter(F.split("_waits", "\n"), lambda x: x.rlike(line)), lambda x: F.struct(F.trim(F.regexp_extract(x, line, 1)).alias("event"), F.regexp_extract(x, line, 5).alias("wait_class"), F.regexp_replace(F.regexp_extract(x, line, 4), ",", "").cast("double").alias("pct_db_time")))
    events = F.filter(events, lambda e: e["pct_db_time"] >= 0.5)
    # a name's first line counts
    names = F.transform("_events", lambda e: e["event"])
    first = F.filter("_events", lambda e, i: F.array_position(names, e["event"]) == i + 1)
    signals = F.array_compact(F.array(*[F.when(F.exists("top_wait_events", _names(w)), s) for w, s in WAITS.items()]))
    statement = r"\b([0-9a-z]{13})\s+([0-9,]+\.?\d*)\s+([0-9,]+\.?\d*)\s+"
    rows = rows.withColumn("_events", events).withColumn("top_wait_events", first).withColumn("wait_signals", F.array_distinct(signals))
    rows = rows.withColumn("db_time_ratio", F.when((F.col("elapsed_mins") > 0) & (F.col("db_time_mins") > 0), F.round(F.col("db_time_mins") / F.col("elapsed_mins"), 2)))
    free = F.col("shared_pool_free_pct")
    memory = F.array_compact(F.array(F.when(free < 10, "SHARED_POOL_EXHAUSTION").when(free < 20, "SHARED_POOL_LOW")))
    hard = F.array_compact(F.array(F.when(F.coalesce(F.col("_sql").rlike(r"(?i)hard\s+pars"), F.lit(False)), "HIGH_HARD_PARSE")))
    load = F.array_compact(F.array(F.when(F.col("db_time_ratio") > 1.5, "DB_TIME_SPIKE"), F.when(F.col("db_time_ratio") > 3, "DB_TIME_CRITICAL")))
    return rows.select(
        "path", "elapsed_mins", "db_time_mins", "db_time_ratio", "top_wait_events", "wait_signals", "sga_total_mb", "pga_total_mb", "shared_pool_free_pct", memory.alias("memory_signals"),
        F.array_distinct(F.regexp_extract_all(F.coalesce("_sql", F.lit("")), F.lit(statement), F.lit(1))).alias("top_sql"), hard.alias("sql_signals"),
        F.array_distinct(F.concat("wait_signals", memory, hard, load)).alias("awr_signals"),
    )


# traces, security, audit --------------------------------------------------------------


def parse_trace(lines: DataFrame) -> DataFrame:
    """Header fields (the last one outside of sections counts) and the
    lines of each section, up to its limit."""
    starts = reduce(lambda acc, kv: acc.when(F.col("line").contains(kv[1][0]), kv[0]), TRACE_SECTIONS.items(), F.when(F.lit(False), ""))
    ends = reduce(lambda a, b: a | b, [F.col("line").contains(e) for _, e, _ in TRACE_SECTIONS.values()])
    mark = F.when(starts.isNotNull(), F.struct(starts.alias("name"), F.col("line_number").alias("at"))).when(ends, F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("at")))
    rows = scan_lines(lines.withColumn("_mark", mark), {"_in": F.col("_mark")})
    body = rows.where(F.col("_in.name").isNotNull() & F.col("_mark").isNull()).withColumn("_name", F.col("_in.name"))
    body = scan_lines(body, counts={"_place": F.lit(1)}, keys=("path", "_name"))
    most = lookup(F.col("_name"), {k: v[2] for k, v in TRACE_SECTIONS.items()}, 0)
    texts = body.where(F.col("_place") <= most).groupBy("path", F.col("_name").alias("section")).agg(F.array_join(gathered(body, "line"), "\n").alias("content"))
    sections = texts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("section", "content"))).alias("sections"))
    outside = rows.where(F.col("_in.name").isNull() | F.col("_mark").isNotNull())
    fields = [F.max_by(group(F.col("line"), p), F.when(F.col("line").rlike(p), F.col("line_number"))).alias(n) for n, p in TRACE_HEADER.items()]
    return outside.groupBy("path").agg(*fields).join(sections, "path", "left")


def highlighted_frames(stack: Column) -> Column:
    """Frames that name a telling component."""
    return F.transform(F.filter(F.split(stack, "\n"), lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(h) for h in STACK_HIGHLIGHTS])), lambda x: F.trim(x))


def parse_security(lines: DataFrame) -> DataFrame:
    """The first manifest pattern that a line matches, then fallbacks."""
    s = F.trim("line")
    low = F.lower(s)
    row = lambda kind, severity, details: F.struct(F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"), details.alias("details"))
    found = [F.when(F.col("line").rlike(p), row(n, sev, F.regexp_extract("line", p, 0))) for n, p, sev in SECURITY]
    found += [
        F.when(s.rlike(r"(?i)\bORA-01017\b|invalid username/password"), row("AUTH_FAILURE", "ERROR", s)),
        F.when(low.rlike(r"failed\s+password|authentication\s+failure|invalid\s+user"), row("AUTH_FAILURE", "WARNING", s)),
        F.when(low.contains("sudo") & (low.contains("fail") | low.contains("incorrect password")), row("AUTH_FAILURE", "WARNING", s)),
        F.when(low.contains("sudo") | s.rlike(r"(?i)\bGRANT\s+DBA\b"), row("PRIVILEGE_CHANGE", "WARNING", s)),
    ]
    return lines.withColumn("_f", F.coalesce(*found)).where("_f is not null").select("path", "line_number", "_f.*", s.alias("raw"))


def parse_audit(files: DataFrame) -> DataFrame:
    """Fields of an audit record, event type and severity."""
    t = F.col("text")
    bracketed = {f: group(t, rf"{f.upper()}\s*:\s*\[\d+\]\s*'(.*)'") for f in AUDIT_FIELDS}
    plain_code = group(t, r"(?i)\bRETURNCODE\s*:\s*(?:\[\d+\]\s*')?(\d+)")
    plain_action = F.regexp_replace(F.trim(group(t, r"(?i)\bACTION\s*:\s*([^\n\r]+?)(?=\s+RETURNCODE\s*:|$)")), "^['\"]+|['\"]+$", "")
    rows = files.select("path", *[(F.coalesce(bracketed["action"], plain_action) if f == "action" else F.coalesce(plain_code, bracketed["returncode"]) if f == "returncode" else bracketed[f]).alias(f) for f in AUDIT_FIELDS], F.trim(t).alias("raw"))
    action, code, raw = F.upper(F.coalesce("action", F.lit(""))), F.coalesce("returncode", F.lit("0")), F.col("raw")
    kind = (
        F.when(raw.rlike(r"(?i)\bGRANT\s+DBA\b|\bREVOKE\s+DBA\b") | (action.contains("GRANT") & action.contains("DBA")), "PRIVILEGE_CHANGE")
        .when(action.rlike(r"\b(CREATE|DROP|ALTER)\s+USER\b"), "PRIVILEGE_CHANGE").when(raw.rlike(r"(?i)\bORA-01017\b|invalid\s+username/password"), "AUTH_FAILURE")
        .when(action.contains("LOGON") & (code != "0"), "AUTH_FAILURE")
    )
    rows = rows.withColumn("event_type", kind)
    rows = rows.withColumn("returncode", F.when((F.col("event_type") == "AUTH_FAILURE") & F.col("returncode").isNull(), "1017").otherwise(F.col("returncode")))
    return rows.withColumn("severity", F.when(F.coalesce("returncode", F.lit("0")) != "0", "ERROR").otherwise("INFO"))


def parse_exawatcher(lines: DataFrame, hostname: str = "unknown") -> DataFrame:
    """P24"""
    p = r"^(ib\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    s = F.trim("line")
    rows = lines.where(s.rlike(p)).select("path", "line_number", F.lit(hostname).alias("hostname"), F.lit("INFINIBAND").alias("component"), F.regexp_extract(s, p, 1).alias("port"), F.regexp_extract(s, p, 2).cast("int").alias("errors"), F.regexp_extract(s, p, 4).cast("int").alias("link_down_count"), s.alias("raw"))
    rows = rows.where("errors > 0 or link_down_count > 0").withColumn("severity", F.when(F.col("link_down_count") > 0, "CRITICAL").otherwise("WARNING"))
    return rows.withColumn("message", F.format_string("InfiniBand port %s has %d symbol errors and %d link down events", "port", "errors", "link_down_count"))


def generic_events(lines: DataFrame) -> DataFrame:
    """P25: any line with a vendor code or a telling word."""
    s = F.trim("line")
    low = F.lower(s)
    codes = F.concat(*[F.regexp_extract_all(s, F.lit(rf"(?i)\b({p})\b")) for p in (r"ORA-\d{5}", r"TNS-\d+", r"CRS-\d+")])
    telling = reduce(lambda a, b: a | b, [low.contains(w) for w in GENERIC_WORDS])
    rows = lines.where((F.length(s) >= 6) & ~s.rlike(AUTH_LINE)).withColumn("codes", codes).where((F.size("codes") > 0) | telling)
    trace = group(s, r"(\S+\.(?:trc|TRC))\b")
    first = F.try_element_at("codes", F.lit(1))
    fallback = (
        F.when(trace.isNotNull(), "TRACE_FILE_REFERENCE").when(low.contains("timeout"), "GENERIC_TIMEOUT_LINE").when(low.contains("offline"), "GENERIC_OFFLINE_LINE")
        .when(low.contains("fail"), "GENERIC_FAILURE_LINE").when(low.contains("error") | low.contains("i/o"), "GENERIC_ERROR_LINE").otherwise("GENERIC_EVIDENCE_LINE")
    )
    last = F.upper(F.element_at("codes", -1))
    out = rows.select(
        "line_number", F.col("path").alias("source_path"), F.lit("generic_text").alias("source_type"), F.coalesce(first, fallback).alias("code"),
        F.when(F.size("codes") > 0, F.substring(last, 1, 3)).otherwise("GENERIC_PATTERN").alias("code_type"), s.alias("message"), trace.alias("trace_file"),
        group(s, r"(?i)\b(sd[a-z]+|dm-\d+|nvme\d+n\d+|hdisk\d+)\b").alias("device"),
        F.coalesce(group(s, r"(?i)(?<![0-9.])\+([A-Za-z][A-Z0-9_$#]*)\b"), group(s, r"(?i)diskgroup\s+['\"]?([A-Za-z][A-Z0-9_$#]*)['\"]?\b")).alias("diskgroup"),
        F.when((F.size("codes") > 0) | low.contains("fail"), "ERROR").otherwise("WARNING").alias("severity"), F.when(F.size("codes") > 0, "MEDIUM").otherwise("LOW").alias("parse_confidence"),
        s.alias("raw"), F.array(F.lit("GENERIC_FALLBACK")).alias("tags"),
    )
    return conform(out, "generic_evidence_parser")
