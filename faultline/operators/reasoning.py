"""Scores, gates and classifications over one row an incident."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import DEFAULT, Settings

# fixed values -----------------------------------------------------------------
WEIGHTS = {
    "LAYER_MEMORY": 30, "LAYER_OS_TRIGGERED": 25, "LAYER_ASM": 25, "LAYER_DB": 20, "LAYER_NETWORK": 20, "LAYER_CLUSTER": 25, "ASM_HIGH_POWER_REBALANCE": 25,
    "LAYER_Storage": 25, "LAYER_Network": 20, "LAYER_Memory": 25, "LAYER_Filesystem": 20, "LAYER_SECURITY": 20, "AUDITD_KILL_9": 30, "LAYER_DATAGUARD": 25, "LAYER_RMAN": 20,
    "LAYER_NEEDS_MORE_INFO": 0, "DB_TIME_SPIKE": 15, "DB_TIME_CRITICAL": 15, "SHARED_POOL_CONTENTION": 15, "PARSE_PRESSURE": 15, "SHARED_POOL_EXHAUSTION": 15, "HIGH_HARD_PARSE": 10,
    "LATCH_CONTENTION": 10, "CPU_SATURATION": 10, "CPU_USER_HIGH": 10, "MEMORY_PRESSURE": 15, "LOW_PHYSICAL_MEMORY": 15, "PROCESS_D_STATE_ZOMBIE": 20, "CRS_CLEAN": 5,
}
#: in a bucket the first active signal counts
BUCKETS = {
    "layer_primary": (
        "LAYER_MEMORY", "LAYER_CLUSTER", "LAYER_ASM", "LAYER_OS_TRIGGERED", "LAYER_Storage", "LAYER_Memory", "LAYER_Filesystem", "LAYER_DB", "LAYER_NETWORK", "LAYER_Network",
        "LAYER_SECURITY", "LAYER_DATAGUARD", "LAYER_RMAN", "LAYER_NEEDS_MORE_INFO", "ASM_HIGH_POWER_REBALANCE", "AUDITD_KILL_9",
    ),
    "awr_time": ("DB_TIME_CRITICAL", "DB_TIME_SPIKE"),
    "awr_pool": ("SHARED_POOL_EXHAUSTION", "SHARED_POOL_CONTENTION", "PARSE_PRESSURE"),
    "awr_sql": ("HIGH_HARD_PARSE", "LATCH_CONTENTION"),
    "osw_cpu": ("CPU_SATURATION", "CPU_USER_HIGH"),
    "osw_memory": ("MEMORY_PRESSURE", "LOW_PHYSICAL_MEMORY"),
    "osw_process": ("PROCESS_D_STATE_ZOMBIE",),
    "crs": ("CRS_CLEAN",),
}
FATAL_OS_EVENTS = ("OS_KERNEL_PANIC", "KERNEL_PANIC", "HARD_LOCKUP")
POOL = ("SHARED_POOL_CONTENTION", "PARSE_PRESSURE", "SHARED_POOL_EXHAUSTION")
#: id, groups of which each needs one signal, category, risk; the first rule counts
CLASS_RULES = (
    ("RULE_MEMORY_FULL", (("LAYER_MEMORY", "LAYER_Memory"), POOL, ("MEMORY_PRESSURE", "LOW_PHYSICAL_MEMORY", "CPU_SATURATION")), "DB / Performance / Memory", "HIGH"),
    ("RULE_MEMORY_AWR", (("LAYER_MEMORY", "LAYER_Memory"), (*POOL, "HIGH_HARD_PARSE")), "DB / Performance / Memory", "HIGH"),
    ("RULE_MEMORY_SUSPECTED", (("LAYER_MEMORY", "LAYER_Memory"),), "DB / Memory", "MEDIUM"),
    ("RULE_OS_TRIGGERED", (("LAYER_OS_TRIGGERED",),), "OS / Infrastructure", "HIGH"),
    ("RULE_ASM", (("LAYER_ASM",),), "DB / Infrastructure / ASM", "HIGH"),
    ("RULE_NETWORK", (("LAYER_NETWORK", "LAYER_Network"),), "Network / Connectivity", "HIGH"),
    ("RULE_CLUSTER", (("LAYER_CLUSTER",),), "DB / Infrastructure / RAC / Cluster", "HIGH"),
    ("RULE_OS_STORAGE", (("LAYER_Storage", "LAYER_Filesystem"),), "OS / Infrastructure / Storage", "HIGH"),
    ("RULE_SECURITY", (("LAYER_SECURITY",),), "DB / Security / Access", "HIGH"),
    ("RULE_DATAGUARD", (("LAYER_DATAGUARD",),), "DB / DataGuard / Standby", "HIGH"),
    ("RULE_RMAN", (("LAYER_RMAN",),), "DB / Backup / Recovery", "MEDIUM"),
    ("RULE_DB_INTERNAL", (("LAYER_DB",),), "DB / Internal", "MEDIUM"),
    ("RULE_PERF_CPU", (("DB_TIME_SPIKE", "DB_TIME_CRITICAL"), ("CPU_SATURATION", "CPU_USER_HIGH")), "DB / Performance / CPU", "MEDIUM"),
    ("RULE_PERF_IO", (("IO_WAIT_HIGH",), ("IO_SINGLE_BLOCK", "IO_MULTI_BLOCK")), "DB / Performance / I/O", "MEDIUM"),
    ("RULE_RAC_GC", (("RAC_GC_CONTENTION",),), "DB / Performance / RAC", "HIGH"),
)
COMPONENTS = ("Shared_Pool", "PGA", "CPU", "IO", "Redo_Log", "Network", "Cluster_RAC", "DataGuard", "Backup", "Security")
RISKS = ("GREEN", "YELLOW", "ORANGE", "RED")
SIGNAL_RISKS = {
    "LAYER_MEMORY": {"Shared_Pool": "RED", "PGA": "ORANGE"}, "LAYER_OS_TRIGGERED": {"IO": "ORANGE", "Shared_Pool": "YELLOW"}, "LAYER_ASM": {"IO": "RED"},
    "LAYER_DB": {"Shared_Pool": "ORANGE"}, "LAYER_NETWORK": {"Network": "RED"}, "LAYER_CLUSTER": {"Cluster_RAC": "RED"}, "LAYER_Storage": {"IO": "RED"}, "LAYER_Network": {"Network": "RED"},
    "LAYER_Memory": {"Shared_Pool": "ORANGE", "PGA": "ORANGE"}, "LAYER_Filesystem": {"IO": "ORANGE"}, "LAYER_SECURITY": {"Security": "RED"}, "LAYER_DATAGUARD": {"DataGuard": "RED"},
    "LAYER_RMAN": {"Backup": "ORANGE"}, "ORA_04031_DETECTED": {"Shared_Pool": "RED"}, "ORA_04030_DETECTED": {"PGA": "RED"}, "SHARED_POOL_CONTENTION": {"Shared_Pool": "RED"},
    "SHARED_POOL_EXHAUSTION": {"Shared_Pool": "RED"}, "PARSE_PRESSURE": {"Shared_Pool": "ORANGE"}, "LATCH_CONTENTION": {"Shared_Pool": "ORANGE"}, "HIGH_HARD_PARSE": {"Shared_Pool": "ORANGE"},
    "IO_SINGLE_BLOCK": {"IO": "ORANGE"}, "IO_MULTI_BLOCK": {"IO": "YELLOW"}, "IO_DIRECT_PATH": {"IO": "YELLOW"}, "REDO_LOG_PRESSURE": {"Redo_Log": "RED"},
    "RAC_GC_CONTENTION": {"Cluster_RAC": "RED"}, "DB_TIME_SPIKE": {"Shared_Pool": "YELLOW", "CPU": "YELLOW"}, "DB_TIME_CRITICAL": {"Shared_Pool": "ORANGE", "CPU": "ORANGE"},
    "ROW_LOCK_CONTENTION": {"Shared_Pool": "YELLOW"}, "CPU_SATURATION": {"CPU": "RED"}, "CPU_USER_HIGH": {"CPU": "ORANGE"}, "MEMORY_PRESSURE": {"Shared_Pool": "ORANGE", "PGA": "ORANGE"},
    "LOW_PHYSICAL_MEMORY": {"Shared_Pool": "RED", "PGA": "RED"}, "IO_WAIT_HIGH": {"IO": "RED"},
}
CORRELATION_LAYERS = ("STORAGE", "INFRA", "OS", "ASM", "DB", "RDBMS", "NETWORK", "BACKUP", "CRS", "SECURITY", "AUDIT")
LAYER_ALIASES = {
    "DATABASE": "DB", "RDBMS": "DB", "CELL": "STORAGE", "EXADATA": "STORAGE", "INFRASTRUCTURE": "INFRA", "KERNEL": "OS", "LINUX": "OS", "AIX": "OS", "FILESYSTEM": "OS",
    "SOLARIS": "OS", "CLUSTER": "CRS", "CLUSTERWARE": "CRS",
}
CATEGORY_LAYERS = (
    ("STORAGE", ("EXADATA", "CELL", "CELLDISK", "GRIDDISK", "FLASH", "STORAGE")), ("ASM", ("ASM", "DISKGROUP")), ("CRS", ("CRS", "CSS", "CLUSTER", "OCR", "VOTING")),
    ("NETWORK", ("NETWORK", "TNS", "LISTENER", "SCAN", "VIP", "NFS", "TCP", "UDP")), ("BACKUP", ("RMAN", "BACKUP", "ARCHIVE", "ARCHIVER")),
    ("OS", ("KERNEL", "SCSI", "MULTIPATH", "HBA", "FILESYSTEM", "CPU", "MEMORY", "OOM", "SWAP")), ("DB", ("ORA", "REDO", "CONTROLFILE", "DATAFILE", "UNDO", "RECOVERY", "DATABASE")),
)
PATTERN_LAYERS = {
    "EXA_FLASH_FAIL": "STORAGE",
    "EXA_CELL_IO_ERROR": "STORAGE",
    "EXA_SMART_SCAN_DISABLED": "STORAGE",
    "STORAGE_FLASH_IO_OR_MEDIA_FAILURE": "STORAGE",
    "EXA_CELL_STOP": "INFRA",
    "EXA_IB_LINK_DOWN": "INFRA",
    "SCSI_DISK_TIMEOUT": "OS",
    "FC_HBA_RESET": "OS",
    "MULTIPATH_ALL_PATHS_DOWN": "OS",
    "IO_QUEUE_TIMEOUT": "OS",
    "OS_STORAGE_PATH_FAILURE": "OS",
    "EXT4_JOURNAL_ABORT": "OS",
    "XFS_FILESYSTEM_SHUTDOWN": "OS",
    "FILESYSTEM_ARCH_FULL": "OS",
    "FILESYSTEM_ANY_FULL": "OS",
    "SMARTCTL_PENDING_SECTOR": "OS",
    "ISCSI_SESSION_FAIL": "OS",
    "LVM_DEVICE_FAIL": "OS",
    "OOM_KILLER_ACTIVE": "OS",
    "CGROUP_OOM_KILL": "OS",
    "MEMORY_SWAP_STORM": "OS",
    "SHMGET_EINVAL": "OS",
    "HUGEPAGES_FREE_ZERO": "OS",
    "SEMAPHORE_LIMIT_EXHAUSTED": "OS",
    "FD_LIMIT_EXHAUSTED": "OS",
    "MEMLOCK_ULIMIT_TOO_LOW": "OS",
    "DEVSHM_TOO_SMALL": "OS",
    "THP_LATENCY_STALL": "OS",
    "CPU_RUNQUEUE_SATURATION": "OS",
    "CPU_STEAL_TIME": "OS",
    "SOFT_LOCKUP": "OS",
    "HARD_LOCKUP": "OS",
    "KERNEL_PANIC": "OS",
    "MCE_CORRECTED_MEMORY": "OS",
    "MCE_UNCORRECTED_MEMORY": "OS",
    "KERNEL_NULL_PTR_DEREF": "OS",
    "SELINUX_BLOCKING": "OS",
    "NTP_TIME_JUMP": "OS",
    "BONDING_FAILOVER_EVENT": "NETWORK",
    "BOTH_NICS_DOWN": "NETWORK",
    "NF_CONNTRACK_FULL": "NETWORK",
    "IB_LINK_DEGRADED": "NETWORK",
    "IPTABLES_BLOCKING_1521": "NETWORK",
    "NFS_MOUNT_TIMEOUT": "NETWORK",
    "UDP_BUFFER_OVERFLOW": "NETWORK",
    "SOCKET_EXHAUSTION": "NETWORK",
    "ASM_DISMOUNT_CRITICAL": "ASM",
    "ORA_ANY_GENERIC": "DB",
    "GENERIC_ORA_EXTRACT": "DB",
}
OS_PATH_PATTERNS = ("SCSI_DISK_TIMEOUT", "FC_HBA_RESET", "MULTIPATH_ALL_PATHS_DOWN", "IO_QUEUE_TIMEOUT")
GRAPH_CODES = {
    "FC_HBA_ABORT": "FC_HBA_RESET", "OS_OOM_KILLER": "OOM_KILLER_ACTIVE", "FLASH_IO_TIMEOUT": "EXA_FLASH_FAIL", "FLASH_CACHE_READ_ERROR": "EXA_FLASH_FAIL",
    "FLASH_DISK_CRITICAL": "EXA_FLASH_FAIL", "STORAGE_BACKEND_LATENCY": "EXA_CELL_IO_ERROR", "STORAGE_MEDIA_READ_FAILURE": "EXA_CELL_IO_ERROR", "STORAGE_ASM_READ_FAILED": "EXA_CELL_IO_ERROR",
}
STORAGE_PATTERNS = (*OS_PATH_PATTERNS, "EXA_FLASH_FAIL", "EXA_CELL_IO_ERROR", "STORAGE_FLASH_IO_OR_MEDIA_FAILURE")
STORAGE_CODES = ("ORA-27072", "ORA-15080", "ORA-15130", "ORA-15081", "ORA-00353")
SOLICITED = {
    "OS_TRIGGERED": ("/var/log/messages", "dmesg", "multipath -ll", "iostat -xz"), "ASM": ("ASM alert log", "asmcmd lsdg", "kfod status"),
    "CLUSTER": ("crsctl check crs", "ocrcheck", "alert.log from other nodes"), "NETWORK": ("lsnrctl status", "netstat -anp", "ping/traceroute"),
    "MEMORY": ("/proc/meminfo", "ipcs -ma", "slabtop"),
}
FINAL_THRESHOLD = 70
# -----------------------------------------------------------------------------


def has(array: Column, *values: str) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])), F.lit(False))


def _table(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def normal_layer(layer: Column) -> Column:
    """aliases become layers, anything unknown UNKNOWN."""
    value = F.upper(F.trim(F.coalesce(layer, F.lit(""))))
    value = F.coalesce(_table(LAYER_ALIASES, value), value)
    return F.when(value.isin(*DEFAULT.layer_depth), value).otherwise("UNKNOWN")


def category_layer(category: Column) -> Column:
    """the first layer one of whose words a category contains."""
    c = F.upper(F.coalesce(category, F.lit("")))
    out = F.when(F.lit(False), "")
    for layer, words in CATEGORY_LAYERS:
        out = out.when(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), layer)
    return out.otherwise("UNKNOWN")


def pattern_layer(pattern: Column) -> Column:
    return F.coalesce(_table(PATTERN_LAYERS, F.upper(F.trim(F.coalesce(pattern, F.lit(""))))), F.lit("UNKNOWN"))


def layer_depth(layer: Column) -> Column:
    return F.coalesce(_table(DEFAULT.layer_depth, layer), F.lit(9))


def event_layer(events: DataFrame) -> Column:
    """an event's own layer, else what its code and its family say."""
    own = F.nullif(normal_layer(F.col("layer")), F.lit("UNKNOWN"))
    kind, code = F.upper(F.coalesce("code_type", F.lit(""))), F.upper(F.coalesce("code", F.lit("")))
    by_kind = _table({"STORAGE_PATTERN": "STORAGE", "OS_PATTERN": "OS", "ASM_PATTERN": "ASM", "CRS": "CRS", "CRS_PATTERN": "CRS", "SECURITY_PATTERN": "SECURITY", "AUDIT_PATTERN": "AUDIT", "TNS": "NETWORK"}, kind)
    vendor = F.when((kind == "ORA") & code.rlike(r"^ORA-\d{5}$"), "DB")
    family = F.nullif(category_layer(F.col("failure_family")), F.lit("UNKNOWN"))
    return F.coalesce(vendor, own, by_kind, F.when(code.startswith("TNS-"), "NETWORK"), family, F.lit("UNKNOWN"))


def graph_pattern(code: Column) -> Column:
    """The graph's name of a normalized code."""
    return F.coalesce(_table(GRAPH_CODES, code), code)


def incident_keys(events: DataFrame, key: str = "incident") -> DataFrame:
    """Distinct things an incident's events name, and how many have a
    time.  One row an incident."""
    e = events.withColumn("_layer", event_layer(events))
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    ora = F.when(F.col("code").rlike(r"(?i)^ORA-\d{5}$"), F.upper("code"))
    return e.groupBy(key).agg(
        F.count("*").alias("n_events"), F.count("timestamp").alias("n_timed"), names("process").alias("processes"), names("device").alias("devices"), names("diskgroup").alias("diskgroups"),
        names("trace_file").alias("trace_files"), F.array_sort(F.collect_set(ora)).alias("oras"), F.array_sort(F.collect_set(F.when(F.col("_layer") != "UNKNOWN", F.col("_layer")))).alias("layers"),
        F.array_sort(F.collect_set(graph_pattern(F.col("code")))).alias("patterns"),
    )


def correlation_strength(n_events, n_timed, n_processes, n_traces, n_devices, n_diskgroups, layers: Column) -> Column:
    """0 to 100 from what corroborates an incident."""
    objects, hardware = n_diskgroups + n_traces, n_devices + n_diskgroups
    known = F.size(F.array_intersect(layers, F.array(*[F.lit(x) for x in CORRELATION_LAYERS])))
    in_ = lambda x: F.array_contains(layers, x)
    score = F.when(n_events >= 2, 8).otherwise(0) + F.when(n_timed >= 2, 15).when(n_timed == 1, 7).otherwise(0)
    score += F.when(n_processes > 0, F.least(F.lit(15), 5 + 5 * F.least(n_processes, F.lit(2)))).otherwise(0)
    score += F.when(objects > 0, F.least(F.lit(20), 10 * F.least(objects, F.lit(2)))).otherwise(0)
    score += F.when(hardware > 0, F.least(F.lit(20), 10 + 5 * F.least(hardware, F.lit(3)))).otherwise(0)
    score += F.when(known >= 2, 20).when(F.size(layers) >= 2, 12).otherwise(0)
    score += F.when(in_("STORAGE") | in_("INFRA"), 10).when((in_("ASM") | in_("OS")) & in_("DB"), 7).when(in_("DB"), 3).otherwise(0)
    return F.least(F.lit(100), score).cast("double")


def root_status(layers: Column, score: Column, has_objects: Column, oras: Column, patterns: Column) -> Column:
    """Never confirmed by nearness in time alone."""
    multi = F.size(F.array_intersect(layers, F.array(*[F.lit(x) for x in CORRELATION_LAYERS]))) >= 2
    db = has(layers, "DB", "RDBMS")
    downstream = db | (F.size(oras) > 0)
    asm_codes = F.exists(oras, lambda o: F.upper(o).rlike("^ORA-15[01]"))
    deep_storage, deep_os = has(layers, "STORAGE"), has(layers, "OS", "INFRA", "NETWORK")
    confirmed = multi & (score >= 65) & has_objects & downstream & (((deep_storage | deep_os) & (db | asm_codes)) | (has(layers, "ASM") & (db | asm_codes)))
    return (
        F.when(confirmed, "CONFIRMED").when(multi & (score >= 50), "LIKELY").when(downstream & (deep_os | deep_storage), F.when(score >= 38, "LIKELY").otherwise("SUSPECTED"))
        .when((F.size(oras) > 0) | (F.size(patterns) > 0) | (F.size(layers) > 0), "SUSPECTED").otherwise("UNKNOWN")
    )


def deepest_pattern(patterns: Column) -> Column:
    """struct(depth, place, pattern, layer) of the deepest known pattern;
    the first of equals."""
    ranked = F.transform(patterns, lambda p, i: F.struct(layer_depth(pattern_layer(p)).alias("depth"), i.alias("place"), p.alias("pattern"), pattern_layer(p).alias("layer")))
    return F.array_min(ranked)


def cascade_order(code: Column) -> Column:
    """T7"""
    u = F.upper(code)
    return F.when(u.rlike("^ORA-15[01]"), 0).when(u == "ORA-27072", 1).when(u.startswith("ORA-003"), 2).otherwise(3)


def root_label(layers: Column, patterns: Column, oras: Column, legacy: Column | None = None) -> Column:
    """struct(root, layer) by the ladder: storage evidence, the deepest
    pattern, several path patterns as one, an earlier root, then codes."""
    legacy = F.lit("") if legacy is None else F.coalesce(legacy, F.lit(""))
    deep = deepest_pattern(patterns)
    pattern, layer = F.coalesce(deep["pattern"], F.lit("")), F.coalesce(deep["layer"], F.lit("UNKNOWN"))
    storage, os_ = has(layers, "STORAGE"), has(layers, "OS")
    paths = F.size(F.array_intersect(patterns, F.array(*[F.lit(p) for p in OS_PATH_PATTERNS])))
    up = F.transform(oras, F.upper)
    asm = F.exists(up, lambda o: o.rlike("^ORA-15[01]"))
    candidates = F.filter(up, lambda o: o != "ORA-00312")
    triangle = F.size(F.array_intersect(up, F.array(F.lit("ORA-27072"), F.lit("ORA-00353"), F.lit("ORA-00312")))) == 3
    skip = (paths > 0) | os_ | asm
    rest = F.filter(candidates, lambda o: ~(skip & (o == "ORA-27072")))
    pick = F.coalesce(F.try_element_at(rest, F.lit(1)), F.try_element_at(candidates, F.lit(1)))
    flash = ("EXA_FLASH_FAIL", "EXA_CELL_IO_ERROR")
    out = lambda root, where: F.struct((F.lit(root) if isinstance(root, str) else root).alias("root"), (F.lit(where) if isinstance(where, str) else where).alias("layer"))
    legacy_layer = F.when((pattern_layer(legacy) == "UNKNOWN") & F.upper(legacy).rlike("^ORA-15[01]"), "ASM").otherwise(pattern_layer(legacy))
    return (
        F.when(storage | legacy.isin(*flash) | pattern.isin(*flash), out("STORAGE_FLASH_IO_OR_MEDIA_FAILURE", "STORAGE"))
        .when((layer == "STORAGE") & (pattern != ""), out(pattern, "STORAGE"))
        .when((layer == "OS") & (pattern != "") & os_, out(F.when(paths >= 2, "OS_STORAGE_PATH_FAILURE").otherwise(pattern), "OS"))
        .when((pattern != "") & (layer != "UNKNOWN"), out(pattern, layer)).when(legacy != "", out(legacy, legacy_layer))
        .when((F.size(up) > 0) & (F.size(candidates) == 0), out("DB_OBJECT_LOCATOR_ONLY_NEEDS_CONTEXT", "DB"))
        .when(triangle & ~storage & ~os_ & (paths == 0) & ~asm, out("DB_REDO_IO_FAILURE_NEEDS_LOWER_LAYER_EVIDENCE", "DB"))
        .when(F.size(up) > 0, out(pick, F.when(pick.rlike("^ORA-15[01]"), "ASM").otherwise("DB"))).otherwise(out("NEEDS_MORE_INFO", "UNKNOWN"))
    )


def analyse(events: DataFrame, key: str = "incident") -> DataFrame:
    """G12-G16 over normalized events: one row an incident with its score,
    status, root and layer."""
    k = incident_keys(events, key)
    n = lambda c: F.size(c)
    k = k.withColumn("score", correlation_strength(F.col("n_events"), F.col("n_timed"), n("processes"), n("trace_files"), n("devices"), n("diskgroups"), F.col("layers")))
    known = F.filter("patterns", lambda p: pattern_layer(p) != "UNKNOWN")
    k = k.withColumn("known_patterns", known)
    objects = (n("devices") > 0) | (n("diskgroups") > 0) | ((n("trace_files") > 0) & (n("processes") > 0))
    k = k.withColumn("root", root_label(F.col("layers"), F.col("known_patterns"), F.col("oras"))).withColumn("status", root_status(F.col("layers"), F.col("score"), objects, F.col("oras"), F.col("known_patterns")))
    unknown = F.col("root.layer") == "UNKNOWN"
    status = F.when((F.col("root.root") == "DB_OBJECT_LOCATOR_ONLY_NEEDS_CONTEXT") | (unknown & (F.col("status") == "CONFIRMED")), "NEEDS_MORE_INFO").otherwise(F.col("status"))
    score = F.when(unknown, F.least(F.col("score"), F.lit(45.0))).otherwise(F.col("score"))
    return k.select(key, "n_events", "layers", "oras", "known_patterns", "devices", "diskgroups", "processes", "trace_files", score.alias("score"), status.alias("status"), F.col("root.root").alias("root_cause"), F.col("root.layer").alias("root_layer"))


def ora_table(events: DataFrame, key: str = "incident") -> DataFrame:
    """Each observed code with its first evidence and order in the
    cascade."""
    codes = events.where(F.col("code").rlike(r"(?i)^ORA-\d{5}$")).withColumn("ora", F.upper("code"))
    first = codes.groupBy(key, "ora").agg(F.min(F.struct(F.coalesce("line_number", F.lit(0)).alias("line"), F.col("message").alias("message"))).alias("f"), F.count("*").alias("n_lines"))
    order = Window.partitionBy(key).orderBy(cascade_order(F.col("ora")), "ora")
    return first.select(key, "ora", "n_lines", F.col("f.line").alias("first_line"), F.col("f.message").alias("first_message"), F.row_number().over(order).alias("cascade_rank"))


def bucket_confidence(signals: Column, root: Column | None = None, frequency: Column | None = None, raw: Column | None = None, settings: Settings = DEFAULT) -> Column:
    """struct(score, label, overrides) of a set of active signals."""
    root = F.lit("") if root is None else F.coalesce(root, F.lit(""))
    frequency = F.lit(1) if frequency is None else F.coalesce(frequency, F.lit(1))
    raw = F.lit("") if raw is None else F.lower(F.coalesce(raw, F.lit("")))
    total = F.lit(0)
    for names in BUCKETS.values():
        first = F.when(F.lit(False), 0)
        for name in names:
            first = first.when(F.array_contains(signals, name), WEIGHTS.get(name, 0))
        total = total + first.otherwise(0)
    fatal = root.isin(*FATAL_OS_EVENTS)
    flood, quiet = (root == "ORA-3136") & (frequency >= settings.cry_wolf_threshold), (root == "ORA-3136") & (frequency < settings.cry_wolf_threshold)
    starved = F.array_contains(signals, "LOG_FILE_SYNC") & F.array_contains(signals, "CPU_SATURATION")
    daemon = (root == "OS_OOM_KILLER") & (raw.contains("multipathd") | raw.contains("iscsid"))
    score = F.when(fatal | flood, 100).when(quiet, F.least(total, F.lit(int(settings.low) - 1))).otherwise(total)
    score = score + F.when(starved, settings.symptom_bonus).otherwise(0)
    score = F.least(F.when(daemon, 100).otherwise(score), F.lit(100))
    label = F.when(score >= settings.high, "CONFIRMED").when(score >= settings.medium, "HIGH_CONFIDENCE").when(score >= settings.low, "PROBABLE").otherwise("SUSPECTED")
    over = F.array_compact(F.array(F.when(fatal, "SUDDEN_DEATH_OVERRIDE"), F.when(quiet, "CRY_WOLF_SUPPRESSED"), F.when(flood, "CRY_WOLF_ESCALATED"), F.when(starved, "STARVED_IO_THREAD"), F.when(daemon, "CRITICAL_DAEMON_KILLED")))
    return F.struct(score.alias("score"), label.alias("label"), over.alias("overrides"))


def classify(signals: Column, confidence: Column) -> Column:
    """struct(rule, category, risk) of the first rule that applies."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("category"), F.lit("").alias("risk")))
    for rule, groups, category, risk in CLASS_RULES:
        ok = reduce(lambda a, b: a & b, [has(signals, *g) for g in groups])
        level = F.when(confidence >= 90, "CRITICAL").otherwise(risk) if risk == "HIGH" else F.lit(risk)
        out = out.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), level.alias("risk")))
    return out.otherwise(F.struct(F.lit("NONE").alias("rule"), F.lit("DB / Unknown").alias("category"), F.lit("LOW").alias("risk")))


def heatmap(signals: DataFrame, key: str) -> DataFrame:
    """(key, component, risk), the highest risk of each component over the
    key's signals (key, signal); green without any."""
    spark = signals.sparkSession
    rules = spark.createDataFrame([(s, c, RISKS.index(r)) for s, cs in SIGNAL_RISKS.items() for c, r in cs.items()], "signal string, component string, level int")
    every = signals.select(key).distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in COMPONENTS], "component string")))
    hit = signals.distinct().join(F.broadcast(rules), "signal").groupBy(key, "component").agg(F.max("level").alias("level"))
    names = F.array(*[F.lit(r) for r in RISKS])
    return every.join(hit, [key, "component"], "left").select(key, "component", F.element_at(names, F.coalesce("level", F.lit(0)) + 1).alias("risk"))


def known_pattern(incidents: DataFrame, stored: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """For incidents (incident_id, ora_code, signals) the stored pattern
    (pattern_id, ora_code, confidence_score, signals) of the same code with
    the most common signals, at least two; of the ten most confident."""
    top = Window.partitionBy("ora_code").orderBy(F.desc("confidence_score"), "pattern_id")
    few = stored.withColumn("_place", F.row_number().over(top)).where(F.col("_place") <= most)
    pairs = incidents.join(few.select("ora_code", "pattern_id", "confidence_score", F.col("signals").alias("_stored"), "_place"), "ora_code")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("signals", "_stored"))).where(F.col("overlap") >= least)
    best = Window.partitionBy("incident_id").orderBy(F.desc("overlap"), "_place")
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("incident_id", "ora_code", "pattern_id", "confidence_score", "overlap")


def report_gate(rows: DataFrame, threshold: float = FINAL_THRESHOLD) -> DataFrame:
    """Adds status and reason.  Columns: mode, primary_ora, layers, oras,
    matched (pattern ids in the evidence), best_pattern, best_score, best_label,
    n_sources, rca_status, rca_score, has_chain."""
    best = F.coalesce("best_pattern", F.lit(""))
    authoritative = F.coalesce(F.col("rca_status").isin("CONFIRMED", "LIKELY") & (F.col("rca_score") >= 85), F.lit(False))
    generic = best == "ORA_ANY_GENERIC"
    absent = (F.col("mode") == "log_paste") & (F.size("matched") > 0) & (best != "") & ~F.array_contains("matched", best)
    below = F.coalesce(F.col("best_score") < threshold, F.lit(False))
    single = F.size(F.array_intersect("layers", F.array(*[F.lit(x) for x in CORRELATION_LAYERS]))) < 2
    storage = (best.isin(*STORAGE_PATTERNS) | has(F.col("oras"), *STORAGE_CODES)) & ~has(F.col("layers"), "INFRA", "STORAGE")
    blocked = (best == "") | (F.coalesce("best_label", F.lit("NO_MATCH")) == "NO_MATCH") | (generic & (F.col("n_sources") < 2)) | absent | single | storage | below
    reason = (
        F.when(generic, "GENERIC_SIGNAL_ONLY").when(absent, "PATTERN_NOT_IN_EVIDENCE").when(below, "BELOW_THRESHOLD").when(storage, "NEEDS_INFRA_EVIDENCE").when(single, "SINGLE_LAYER")
        .when((F.coalesce("primary_ora", F.lit("")) != "") & ~F.col("has_chain"), "NOT_OS_TRIGGERED").otherwise("NO_CONFIDENT_PATTERN")
    )
    no = blocked & ~authoritative
    return rows.withColumn("report_status", F.when(no, "NO_MATCH").otherwise("SUCCESS")).withColumn("no_match_reason", F.when(no, reason))


def downgrade(rows: DataFrame) -> DataFrame:
    """A report without a match confirms no root cause."""
    no = F.col("report_status") == "NO_MATCH"
    return (
        rows.withColumn("rca_score", F.when(no, F.round(F.least("rca_score", F.lit(40.0)), 1)).otherwise(F.col("rca_score")))
        .withColumn("rca_status", F.when(no, "NEEDS_MORE_INFO").otherwise(F.col("rca_status"))).withColumn("root_cause", F.when(no, "UNKNOWN").otherwise(F.col("root_cause")))
    )


def layered_fixes(fixes: DataFrame, key: str = "incident") -> DataFrame:
    """Infrastructure, base, then database fixes (incident, fix_id, tier,
    priority); one a fix, numbered anew."""
    tier = F.when(F.col("tier") == "INFRA", 0).when(F.col("tier") == "BASE", 1).otherwise(2)
    once = fixes.withColumn("_tier", tier).withColumn("_n", F.row_number().over(Window.partitionBy(key, "fix_id").orderBy("_tier", "priority"))).where("_n = 1")
    return once.withColumn("priority", F.row_number().over(Window.partitionBy(key).orderBy("_tier", "priority", "fix_id"))).drop("_tier", "_n")


def solicit(incidents: DataFrame, provided: DataFrame, key: str = "incident") -> DataFrame:
    """The logs a layer's checklist asks for and no provided source
    (incident, source) covers."""
    spark = incidents.sparkSession
    asks = spark.createDataFrame([(layer, k, s) for layer, ss in SOLICITED.items() for k, s in enumerate(ss)], "layer string, place int, suggestion string")
    wanted = incidents.select(key, "layer").join(F.broadcast(asks), "layer")
    have = provided.where(F.length("source") >= 4).select(key, F.upper("source").alias("_have")).distinct()
    u = F.upper("suggestion")
    covers = u.contains(F.col("_have")) | F.col("_have").contains(u) | (u.rlike("MESSAGES|DMESG|SYSLOG") & F.col("_have").rlike("MESSAGES|DMESG|SYSLOG|/VAR/LOG"))
    covers = covers | (u.contains("ASM ALERT") & F.col("_have").rlike(r"ASM")) | (u.rlike("CRSCTL|OCRCHECK") & F.col("_have").rlike(r"CRS|GRID|OCR|EVMD|CSSD"))
    covered = wanted.join(have, key).where(covers).select(key, "suggestion").distinct()
    return wanted.join(covered, [key, "suggestion"], "left_anti").select(key, "layer", "place", "suggestion")


def follow_up(pairs: DataFrame, hours: float = 6) -> DataFrame:
    """Adds the reasons against joining follow-up evidence to an incident:
    base_* and new_* codes, host, platform and time."""
    differ = lambda a, b, skip=(): F.coalesce((F.col(a) != "") & (F.col(b) != "") & ~F.upper(a).isin(*skip, "") & ~F.upper(b).isin(*skip, "") & (F.lower(a) != F.lower(b)), F.lit(False))
    codes = (F.size("base_codes") > 0) & (F.size("new_codes") > 0) & ~F.arrays_overlap("base_codes", "new_codes")
    late = F.coalesce(F.abs(F.unix_timestamp("new_ts") - F.unix_timestamp("base_ts")) > hours * 3600, F.lit(False))
    reasons = F.array_compact(F.array(F.when(codes, "CODES"), F.when(differ("base_host", "new_host"), "HOST"), F.when(differ("base_platform", "new_platform", ("UNKNOWN",)), "PLATFORM"), F.when(late, "TIME")))
    return pairs.withColumn("reasons", reasons).withColumn("related", F.size("reasons") == 0)


def off_policy(found: Column, allowed: Column) -> Column:
    """U8: codes of a text that aren't allowed."""
    return F.array_except(F.array_distinct(F.transform(found, F.upper)), F.transform(allowed, F.upper))


def grounded_picks(indexes: Column, size: Column, most: int = 14) -> Column:
    """Picks that exist, once each, up to a limit."""
    return F.slice(F.array_distinct(F.filter(indexes, lambda i: (i >= 0) & (i < size))), 1, most)
