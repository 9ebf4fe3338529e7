"""Queries of evidence, reasoning, chunk and knowledge operators over the
event table, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import chunking, evidence, patterns, reasoning, sessions, translator
from faultline.operators import parsers as P
from faultline.plans.catalog import query
from faultline.plans.diagnose import diagnose
from faultline.plans.frames import table
from faultline.plans.ingest import normalized_events
from faultline.plans.log_catalog import by_type, event_files, event_id, event_lines, event_type, host_lines, long, ntz, stamp, text, user_id

# lines as correlation evidence ------------------------------------------------------------

def _evidence_line() -> Column:
    return by_type(
        text("all is well today"), error=text(stamp("yyyy-MM-dd HH:mm:ss"), " ORA-27072: File I/O error sdb /u01/db_", user_id(), ".trc"), signup=text("kernel: blk_update_request: I/O error, dev sdc, sector ", event_id()),
        purchase=text("CELLSRV: FLASH_IO_TIMEOUT on FD_", event_id()), click=text("LGWR (ospid: ", event_id(), "): terminating the instance"),
    )
_SCANNED = """scanned AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment,
  CASE event_type WHEN 'error' THEN 'DB' WHEN 'signup' THEN 'OS' WHEN 'purchase' THEN 'STORAGE' ELSE 'DB' END AS layer, CASE event_type WHEN 'error' THEN 'sdb' WHEN 'signup' THEN 'sdc' ELSE '' END AS device,
  CASE WHEN event_type = 'click' THEN 'LGWR' ELSE '' END AS process, CASE WHEN event_type = 'error' THEN '/u01/db_' || user_id || '.trc' ELSE '' END AS trace_file,
  CASE event_type WHEN 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ORA-27072: File I/O error sdb /u01/db_' || user_id || '.trc' WHEN 'signup' THEN 'kernel: blk_update_request: I/O error, dev sdc, sector ' || event_id
   WHEN 'purchase' THEN 'CELLSRV: FLASH_IO_TIMEOUT on FD_' || event_id ELSE 'LGWR (ospid: ' || event_id || '): terminating the instance' END AS preview
  FROM events WHERE event_type <> 'view')"""


def _scanned(spark, sf_dir) -> DataFrame:
    return evidence.scan_lines(host_lines(spark, sf_dir, _evidence_line())).withColumn("incident", F.substring("path", 5, 20).cast("long"))


@query(f"""WITH {_SCANNED} SELECT 'host' || user_id AS path, event_id - 1 AS line_index, CASE WHEN event_type = 'error' THEN moment ELSE '' END AS timestamp_raw, layer, process, CASE WHEN event_type = 'error' THEN 'ORA-27072' ELSE '' END AS codes,
 device, trace_file, CASE WHEN event_type = 'click' THEN 'CRITICAL' ELSE 'ERROR' END AS severity, preview FROM scanned""")
def line_scan_events(spark, sf_dir):
    """lines that name a code or show a layer."""
    return _scanned(spark, sf_dir).select("path", long("line_index"), "timestamp_raw", "layer", "process", F.array_join("ora_codes", ",").alias("codes"), "device", "trace_file", "severity", "preview")


@query(f"""WITH {_SCANNED} SELECT 'host' || user_id AS path, event_id - 1 AS line_index, layer, CASE WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type = 'click' THEN 'CRITICAL' ELSE 'ERROR' END AS severity FROM scanned""")
def merged_evidence(spark, sf_dir):
    """U4: normalized events first, scanned ones for what they lack."""
    scanned = _scanned(spark, sf_dir)
    normalized = scanned.where("array_contains(ora_codes, 'ORA-27072')").withColumn("severity", F.lit("CRITICAL"))
    return evidence.merge_events(normalized, scanned).select("path", long("line_index"), "layer", "severity")


#: made-up lines get longer with their host's number, but not beyond what a log's line has
LONGEST_LINE = 2000


@query("""SELECT 'host' || user_id AS path, greatest(event_id - 1, 0) AS line_index, CASE event_type WHEN 'error' THEN 'DB' WHEN 'click' THEN 'STORAGE' WHEN 'signup' THEN 'OS' WHEN 'purchase' THEN 'NETWORK' ELSE 'ASM' END AS layer,
 CASE WHEN event_type = 'error' THEN 'ORA-00600' ELSE '' END AS codes, 'mpath' || event_id AS device, repeat('x', least(user_id + 200, 220)) || CASE WHEN user_id > 20 THEN '…' ELSE '' END AS preview FROM events""")
def projected_events(spark, sf_dir):
    """normalized events as correlation events."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    rows = e.select(
        text("host", user_id()).alias("source_path"), none.alias("source_file"), event_id().cast("int").alias("line_number"), none.alias("timestamp_raw"), F.col("ts").alias("timestamp"),
        by_type(text("UNKNOWN"), click=text("infra"), signup=text("kernel")).alias("layer"), by_type(text("X"), error=text("ora-00600"), purchase=text("TNS-12541")).alias("code"),
        by_type(text("OTHER"), error=text("ORA")).alias("code_type"), by_type(view=text("ASM failure")).alias("failure_family"), by_type(click=text("cell1")).alias("cell"), none.alias("flash_disk"), none.alias("process"),
        none.alias("os_errno"), none.alias("trace_file"), none.alias("diskgroup"), none.alias("au"), none.alias("offset"), F.lit("").alias("device"), text("mpath", event_id()).alias("multipath_device"), none.alias("severity"),
        F.repeat(F.lit("x"), (F.least(user_id(), F.lit(LONGEST_LINE)) + 200).cast("int")).alias("raw"), none.alias("preview"),
    )
    return evidence.project_events(rows).select("path", long("line_index"), "layer", F.array_join("ora_codes", ",").alias("codes"), "device", "preview")


@query(f"""WITH {_SCANNED}, k AS (SELECT user_id, string_agg(DISTINCT nullif(device, ''), ',' ORDER BY nullif(device, '')) AS devices, string_agg(DISTINCT nullif(trace_file, ''), ',') AS traces,
  string_agg(DISTINCT nullif(process, ''), ',') AS processes, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM scanned GROUP BY 1)
SELECT user_id AS incident, 'ORA-27072' AS error, 'RDBMS' AS layer, 'DB_IO_SYMPTOM' AS role, 'a file could not be read' AS meaning, min_by(preview, event_id) AS evidence_preview,
 concat_ws('; ', 'device=' || any_value(devices), 'trace=' || any_value(traces), 'process=' || any_value(processes), 'layers=' || any_value(layers)) AS correlation_key, CAST(1 AS INTEGER) AS cascade_rank
FROM scanned JOIN k USING (user_id) WHERE event_type = 'error' GROUP BY user_id""")
def observed_code_rows(spark, sf_dir):
    """A row for each code with role, meaning and what it shares."""
    meanings = spark.createDataFrame([("ORA-27072", " a file could not be read ")], "error string, extracted string")
    return evidence.ora_rows(_scanned(spark, sf_dir), meanings=meanings)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'from the extract' WHEN 'click' THEN 'from the catalogue' ELSE 'ORA-' || lpad(CAST(user_id AS VARCHAR), 5, '0') || ': definition not in the message extract — verify in the error messages reference.' END AS meaning FROM events""")
def code_meanings(spark, sf_dir):
    """The ladder of sources of a meaning."""
    code = text(" ora-", F.lpad(user_id().cast("string"), 5, "0"))
    listed = by_type(text(evidence.PLACEHOLDER), error=text("from the catalogue"), click=text("from the catalogue"))
    return table(spark, sf_dir, "events").select("event_id", evidence.ora_meaning(code, by_type(text("  "), error=text(" from the extract")), listed).alias("meaning"))


@query(f"""WITH {_SCANNED} SELECT user_id AS incident, 'LGWR_INSTANCE_TERMINATION' AS event, 'NON_ORA_EVENT' AS row_kind, 'DB' AS layer, 'FINAL_IMPACT' AS role, min_by(preview, event_id) AS evidence_preview FROM scanned WHERE event_type = 'click' GROUP BY 1
UNION ALL SELECT user_id, 'FLASH_IO_TIMEOUT', 'STORAGE_SIGNAL', 'STORAGE', 'ROOT_CAUSE', min_by(preview, event_id) FROM scanned WHERE event_type = 'purchase' GROUP BY 1
UNION ALL SELECT DISTINCT user_id, CASE event_type WHEN 'signup' THEN 'SCSI_DISK_TIMEOUT' ELSE 'EXA_FLASH_FAIL' END, 'PATTERN_MATCH', CASE event_type WHEN 'signup' THEN 'OS' ELSE 'STORAGE' END,
 CASE event_type WHEN 'signup' THEN 'INTERMEDIATE_CAUSE' ELSE 'ROOT_CAUSE' END, '(matched in direct input / chunk text)' FROM events WHERE event_type IN ('signup', 'purchase')""")
def non_code_rows(spark, sf_dir):
    """What an incident shows that isn't a code."""
    e = table(spark, sf_dir, "events")
    matched = e.select(user_id().alias("incident"), by_type(text("ORA_ANY_GENERIC"), signup=text("SCSI_DISK_TIMEOUT"), purchase=text("EXA_FLASH_FAIL")).alias("pattern_id"))
    return evidence.non_ora_rows(_scanned(spark, sf_dir), matched)


@query("""SELECT event_id, CASE event_type
 WHEN 'error' THEN '[NEEDS_EVIDENCE: storage/cell/SAN logs to confirm deepest backend root]|ASM: ORA-15080 [CONFIRMED]|DB: ORA-27072 [CONFIRMED]|DB: LGWR_INSTANCE_TERMINATION [CONFIRMED]'
 WHEN 'click' THEN 'STORAGE_FLASH_IO_OR_MEDIA_FAILURE [CONFIRMED]|SCSI_DISK_TIMEOUT [CONFIRMED]|DB: ORA-00353 [CONFIRMED]'
 WHEN 'signup' THEN 'FC_HBA_RESET [INFERRED]|ROOT: FC_HBA_RESET [CONFIRMED]|DB: ORA-01555 [CONFIRMED]|[INFERRED: OS path symptoms from pattern match — confirm with host logs]'
 WHEN 'purchase' THEN '[NEEDS_EVIDENCE: storage/cell/SAN logs to confirm deepest root]|DB: ORA-27072 [CONFIRMED]' ELSE 'STORAGE/INFRA [CONFIRMED]' END AS steps FROM events""")
def marked_cascades(spark, sf_dir):
    """The steps of a cascade with their marks."""
    names = lambda **by: F.split(by_type(text(""), **{k: text(v) for k, v in by.items()}), ",")
    some = lambda a: F.filter(a, lambda x: x != "")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type", some(names(error="ASM,DB", click="STORAGE,OS,DB", signup="DB", purchase="DB", view="INFRA")).alias("layers"), some(names(click="SCSI_DISK_TIMEOUT", signup="FC_HBA_RESET")).alias("patterns"),
        some(names(error="ORA-27072,ORA-15080", click="ORA-00353", purchase="ORA-27072")).alias("oras"), some(names(signup="ROOT: FC_HBA_RESET,DB: ORA-01555", purchase="DB: ORA-27072")).alias("chain"),
    )
    steps = evidence.marked_cascade(F.col("layers"), F.col("patterns"), F.col("oras"), F.col("chain"), event_type() == "error")
    return rows.select("event_id", F.array_join(steps, "|").alias("steps"))


@query(f"""WITH {_SCANNED} SELECT user_id AS incident, CAST(place AS INTEGER) AS place, timestamp, layer, event, preview FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id, preview) AS place FROM (
SELECT *, CASE WHEN event_type = 'error' THEN moment ELSE '(no parseable ts)' END AS timestamp, CASE WHEN event_type = 'error' THEN 'ORA-27072' ELSE preview[:80] END AS event FROM scanned)) WHERE place <= 40""")
def evidence_timeline(spark, sf_dir):
    """The first forty events of an incident by the spelling of times."""
    return evidence.timeline(_scanned(spark, sf_dir))


@query("SELECT o_orderkey AS incident_id, o_orderdate AS created_at, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_patterns(spark, sf_dir):
    """T10"""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderdate").alias("created_at"), "o_custkey")
    return evidence.recent(rows)


@query("SELECT min(n_nationkey) AS cascade_id, 'root' || n_regionkey AS root_pattern FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0) GROUP BY n_regionkey")
def cascades_by_root(spark, sf_dir):
    """The first cascade of each root."""
    cascades = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cascade_id"), text("root", F.col("n_regionkey")).alias("root_pattern"))
    roots = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(text("root", F.col("r_regionkey")).alias("root_pattern"))
    return evidence.cascades_of(cascades, roots).select("cascade_id", "root_pattern")


@query("""SELECT event_id, trim('CATEGORY:' || event_type || ' SEVERITY:ERROR ORA:' || CASE WHEN event_type = 'error' THEN 'ORA-00600' ELSE '' END || ' PLATFORM:LINUX PATTERN: ' || props) AS embedded,
 trim(CASE WHEN event_type = 'error' THEN 'ORA:ORA-00600 ' ELSE '' END || 'PLATFORM:LINUX ' || props) AS asked FROM events""")
def embed_texts(spark, sf_dir):
    """R4"""
    ora, platform, props = by_type(error=text("ORA-00600")), F.lit("LINUX"), F.col("props")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", evidence.embed_text(event_type(), F.lit("ERROR"), ora, platform, F.lit(None).cast("string"), props).alias("embedded"), evidence.query_text(props, ora, platform).alias("asked"))


@query("""WITH c AS (SELECT DISTINCT user_id AS session_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'h' || user_id END AS hostname, event_type AS file_source, props AS content,
  'CHK-' || substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)), 1, 12) AS chunk_id FROM events)
SELECT session_id, chunk_id, hostname, content, file_source FROM c""")
def session_append(spark, sf_dir):
    """K5: chunks added to sessions; those that are there aren't added again."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    new = e.select(user_id().alias("session_id"), F.when(event_type() != "error", text("h", user_id())).alias("hostname"), none.alias("timestamp"), F.col("props").alias("content"), event_type().alias("file_source"))
    empty = spark.createDataFrame([], "session_id long, chunk_id string, hostname string, timestamp string, content string, file_source string")
    half = evidence.append_session(empty, new.where("file_source in ('error', 'click')"))
    return evidence.append_session(half, new).drop("timestamp")


@query("""SELECT item_id, CASE WHEN regexp_matches(text, '(?i)the') THEN 'ORA-1,ORA-2' || CASE WHEN regexp_matches(text, '(?i)and') THEN ',ORA-3' ELSE '' END WHEN regexp_matches(text, '(?i)and') THEN 'ORA-2,ORA-3' ELSE '' END AS hints FROM benchmark""")
def language_hint_codes(spark, sf_dir):
    """Codes that a question's words suggest."""
    rules = [("the", ["ORA-1", "ORA-2"]), ("and", ["ORA-2", "ORA-3"])]
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(evidence.language_hints(F.col("text"), rules), ",").alias("hints"))


@query("""SELECT user_id AS incident, kind, CAST(row_number() OVER (PARTITION BY user_id, kind ORDER BY value DESC, event_id) AS INTEGER) AS place, event_id AS chunk_id, props AS excerpt FROM events JOIN (VALUES ('error', 'trace'), ('click', 'security'),
 ('signup', 'hardware'), ('purchase', 'hardware'), ('purchase', 'trace')) k(event_type, kind) USING (event_type) QUALIFY place <= 5""")
def retrieved_evidence(spark, sf_dir):
    """Traces, security events and hardware among retrieved chunks."""
    chunks = table(spark, sf_dir, "events").select(
        user_id().alias("incident"), event_id().alias("chunk_id"), F.col("value").alias("score"), F.col("props").alias("raw_text"), by_type(text("OTHER"), signup=text("disk"), click=text("Security")).alias("category"),
        by_type(text("X"), purchase=text("TRACE_HEADER")).alias("log_source"), by_type(error=text("/u01/x.trc")).alias("trace_path"), by_type(purchase=text("sdb")).alias("device"),
    )
    return evidence.payload_evidence(chunks)


@query("""SELECT event_id AS incident, concat_ws(chr(10), 'Incident: ' || event_id, 'Status: SUCCESS', 'Root cause: <' || event_type || '>', 'Confidence: LIKELY 61.5', CASE WHEN event_type = 'error' THEN 'Cascade:' || chr(10) || '  - a & b' || chr(10) || '  - c' END) AS text,
 '<table><tr><th>Incident</th><td>' || event_id || '</td></tr><tr><th>Status</th><td>SUCCESS</td></tr><tr><th>Root cause</th><td>&lt;' || event_type || '&gt;</td></tr><tr><th>Confidence</th><td>LIKELY 61.5</td></tr></table>'
 || CASE WHEN event_type = 'error' THEN '<h2>Cascade</h2><ol><li>a &amp; b</li><li>c</li></ol>' ELSE '' END AS html FROM events""")
def report_texts(spark, sf_dir):
    """K7: reports as text and as HTML."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "events").select(
        event_id().alias("incident"), F.lit("SUCCESS").alias("report_status"), text("<", event_type(), ">").alias("root_cause"), F.lit("LIKELY").alias("rca_status"), F.lit(61.5).alias("rca_score"),
        F.when(event_type() == "error", F.array(F.lit("a & b"), F.lit("c"))).otherwise(none).alias("steps"), none.alias("fixes"),
    )
    return evidence.report_text(rows)


# reasoning --------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'STORAGE_FLASH_IO_OR_MEDIA_FAILURE' WHEN 'click' THEN 'OS_STORAGE_PATH_FAILURE' WHEN 'signup' THEN 'DB_OBJECT_LOCATOR_ONLY_NEEDS_CONTEXT'
 WHEN 'purchase' THEN 'ORA-15080' ELSE 'NEEDS_MORE_INFO' END AS root, CASE event_type WHEN 'error' THEN 'STORAGE' WHEN 'click' THEN 'OS' WHEN 'signup' THEN 'DB' WHEN 'purchase' THEN 'ASM' ELSE 'UNKNOWN' END AS layer FROM events""")
def root_labels(spark, sf_dir):
    """The ladder from storage evidence to codes."""
    some = lambda **by: F.filter(F.split(by_type(text(""), **{k: text(v) for k, v in by.items()}), ","), lambda x: x != "")
    label = reasoning.root_label(some(error="STORAGE,DB", click="OS,DB", signup="DB", purchase="ASM"), some(click="SCSI_DISK_TIMEOUT,FC_HBA_RESET"), some(error="ORA-27072", signup="ORA-00312", purchase="ORA-15080,ORA-27072"))
    return table(spark, sf_dir, "events").select("event_id", label.alias("r")).select("event_id", "r.root", "r.layer")


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'SUCCESS' ELSE 'NO_MATCH' END AS report_status,
 CASE event_type WHEN 'click' THEN 'GENERIC_SIGNAL_ONLY' WHEN 'signup' THEN 'PATTERN_NOT_IN_EVIDENCE' WHEN 'view' THEN 'BELOW_THRESHOLD' END AS no_match_reason,
 CASE WHEN event_type IN ('error', 'purchase') THEN 'LIKELY' ELSE 'NEEDS_MORE_INFO' END AS rca_status, CASE event_type WHEN 'error' THEN 90.0::DOUBLE WHEN 'purchase' THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END AS rca_score,
 CASE WHEN event_type IN ('error', 'purchase') THEN 'X' ELSE 'UNKNOWN' END AS root_cause FROM events""")
def gated_reports(spark, sf_dir):
    """Reports that lack a match say why, and confirm nothing."""
    best = by_type(text("NTP_TIME_JUMP"), click=text("ORA_ANY_GENERIC"), error=text(""))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("log_paste").alias("mode"), F.lit("").alias("primary_ora"), F.array(F.lit("OS"), F.lit("DB")).alias("layers"), F.array().cast("array<string>").alias("oras"),
        F.when(event_type() == "signup", F.array(F.lit("OTHER"))).when(event_type() == "click", F.array(F.lit("ORA_ANY_GENERIC"))).otherwise(F.array(F.lit("NTP_TIME_JUMP"))).alias("matched"), best.alias("best_pattern"),
        F.when(event_type() == "view", 50.0).otherwise(80.0).alias("best_score"), F.lit("HIGH").alias("best_label"), F.lit(1).alias("n_sources"), F.lit("LIKELY").alias("rca_status"),
        F.when(event_type() == "error", 90.0).otherwise(60.0).alias("rca_score"), F.lit(True).alias("has_chain"), F.lit("X").alias("root_cause"),
    )
    return reasoning.downgrade(reasoning.report_gate(rows)).select("event_id", "report_status", "no_match_reason", "rca_status", "rca_score", "root_cause")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS place FROM events""")
def cascade_orders(spark, sf_dir):
    """T7"""
    code = by_type(text("ORA-01555"), error=text("ora-15080"), click=text("ORA-27072"), signup=text("ORA-00353"))
    return table(spark, sf_dir, "events").select("event_id", reasoning.cascade_order(code).alias("place"))


@query("""WITH f AS (SELECT user_id AS incident, event_type AS fix_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS tier, min(event_id) AS priority FROM events GROUP BY 1, 2, 3)
SELECT incident, fix_id, CAST(row_number() OVER (PARTITION BY incident ORDER BY tier, priority, fix_id) AS INTEGER) AS priority FROM f""")
def fixes_in_layers(spark, sf_dir):
    """Infrastructure, base, then database fixes, each once."""
    rows = table(spark, sf_dir, "events").select(user_id().alias("incident"), event_type().alias("fix_id"), by_type(text("DB"), purchase=text("INFRA"), click=text("BASE")).alias("tier"), event_id().alias("priority"))
    return reasoning.layered_fixes(rows).select("incident", "fix_id", "priority")


@query("""WITH asked AS (SELECT DISTINCT event_id AS incident, layer, CAST(place AS INTEGER) AS place, suggestion FROM events JOIN (VALUES ('error', 'ASM', 0, 'ASM alert log'), ('error', 'ASM', 1, 'asmcmd lsdg'), ('error', 'ASM', 2, 'kfod status'),
 ('click', 'OS_TRIGGERED', 0, '/var/log/messages'), ('click', 'OS_TRIGGERED', 1, 'dmesg'), ('click', 'OS_TRIGGERED', 2, 'multipath -ll'), ('click', 'OS_TRIGGERED', 3, 'iostat -xz')) a(event_type, layer, place, suggestion) USING (event_type))
SELECT * FROM asked WHERE NOT (suggestion = 'ASM alert log') AND NOT (suggestion IN ('/var/log/messages', 'dmesg'))""")
def wanted_evidence(spark, sf_dir):
    """Logs that a layer's checklist asks for and nobody gave."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'click')")
    layer = by_type(error=text("ASM"), click=text("OS_TRIGGERED"))
    provided = e.select(event_id().alias("incident"), by_type(error=text("+asm_alert.log"), click=text("syslog.1")).alias("source"))
    return reasoning.solicit(e.select(event_id().alias("incident"), layer.alias("layer")), provided)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'FC_HBA_RESET' WHEN 'click' THEN 'EXA_FLASH_FAIL' WHEN 'signup' THEN 'OOM_KILLER_ACTIVE' ELSE 'same' END AS pattern, concat_ws(',', 0, event_id % 5 + 1) AS picks FROM events""")
def graph_names_and_picks(spark, sf_dir):
    """The graph's names of codes; picks that exist, once each."""
    code = by_type(text("same"), error=text("FC_HBA_ABORT"), click=text("FLASH_CACHE_READ_ERROR"), signup=text("OS_OOM_KILLER"))
    picks = reasoning.grounded_picks(F.array(F.lit(0), F.lit(-1), (event_id() % 5 + 1).cast("int"), F.lit(0), F.lit(99)), F.lit(10))
    return table(spark, sf_dir, "events").select("event_id", reasoning.graph_pattern(code).alias("pattern"), F.array_join(picks.cast("array<string>"), ",").alias("picks"))


# knowledge ----------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS source, n_regionkey AS target, 'in' AS type FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey <> 1""")
def graph_edits(spark, sf_dir):
    """Edges added once, and rejected ones gone."""
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.lit("in").alias("type"))
    grown = patterns.add_edges(edges.where("source < 10"), edges.unionByName(edges))
    return patterns.reject_edges(grown, edges.where("source % 3 = 0 or target = 1"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_name), 'red')")
def nodes_by_words(spark, sf_dir):
    """G9"""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"))
    return patterns.nodes_with_words(nodes, "Green", "red")


@query("""SELECT event_id AS chunk_id, CASE WHEN event_type = 'click' THEN 'DISK' WHEN event_id < 100 THEN event_type ELSE 'ORACLE' END AS category, CASE WHEN event_type = 'click' THEN 'INFO' WHEN event_id < 100 THEN 'OLD' ELSE 'ERROR' END AS severity
FROM events WHERE event_id >= 100 OR event_type <> 'click' UNION ALL SELECT event_id, event_type, 'OLD' FROM events WHERE event_id < 100 AND event_type = 'click'""")
def learned_incidents(spark, sf_dir):
    """K9: validated new incidents after the stored ones."""
    e = table(spark, sf_dir, "events")
    stored = e.where("event_id < 100").select(event_id().alias("chunk_id"), event_type().alias("category"), F.lit("OLD").alias("severity"))
    new = e.select(event_id().alias("chunk_id"), by_type(text("nonsense"), click=text("DISK")).alias("category"), by_type(text("?"), click=text("INFO")).alias("severity"))
    return sessions.learned(stored, new.unionByName(new))


@query("""SELECT event_id, 'a' || user_id || 'b' AS cleaned, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE value END AS number FROM events""")
def cleaned_values(spark, sf_dir):
    """no NUL bytes, no infinities."""
    number = F.when(event_type() == "error", F.when(event_id() % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", T.clean(text("a", user_id(), "b\0", "c" * 30), F.lit(2) + F.length(user_id().cast("string"))).alias("cleaned"), T.finite(number, -1.0).alias("number"))


# chunks -------------------------------------------------------------------------------------


@query("""SELECT 'c' AS collection_id, 'node' || user_id AS hostname, CASE WHEN event_type = 'error' THEN 'NETWORK' ELSE 'CRS' END AS category, CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE 'ERROR' END AS severity,
 CASE WHEN event_type = 'error' THEN 'ORA-29740' ELSE '' END AS ora_code, CAST(2 AS INTEGER) AS line_count, date_trunc('second', ts) AS timestamp_start FROM events WHERE event_type IN ('error', 'click')
UNION ALL SELECT 'c', 'unknown', 'CRS', 'ERROR', '', 1, date_trunc('second', ts) + INTERVAL 40 SECOND FROM events WHERE event_type IN ('error', 'click')""")
def crs_window_chunks(spark, sf_dir):
    """Cluster-log windows of 30 seconds."""
    at = lambda seconds: F.date_format(F.date_trunc("second", "ts") + F.expr(f"INTERVAL {seconds} SECOND"), "yyyy-MM-dd HH:mm:ss.S")
    code = F.when(event_type() == "error", "CRS-1618").otherwise("CRS-9999")
    content = text(at(0), " [CSSD]", code, ": Node node", user_id(), " is not responding\n", at(10), " [CSSD]CRS-8888: more\n", at(40), " [CSSD]CRS-7777: later\n", at(41), " [CSSD]CRS-2676: benign")
    rows = P.parse_crs(event_lines(spark, sf_dir, F.when(event_type().isin("error", "click"), content)))
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return chunking.crs_chunks(rows, "c").select("collection_id", "hostname", "category", "severity", "ora_code", "line_count", ntz("timestamp_start"))


@query("""SELECT 'host' || user_id AS hostname, 'DF' AS log_source, CASE WHEN event_type = 'error' THEN 'DISK' ELSE 'OS' END AS category, event_type AS severity, props AS raw_text, CAST(1 AS INTEGER) AS line_count, date_trunc('second', ts) AS timestamp_start,
 substr(sha256('c:df|host' || user_id || ':' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) || ':' || strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')), 1, 16) AS chunk_id FROM events""")
def entry_row_chunks(spark, sf_dir):
    """A chunk for each row."""
    rows = table(spark, sf_dir, "events").select(text("host", user_id()).alias("path"), event_id().alias("line_number"), F.date_trunc("second", "ts").cast("timestamp").alias("timestamp"), event_type().alias("severity"), F.col("props").alias("raw"))
    out = chunking.entry_chunks(rows, "c", "DF", F.when(F.col("severity") == "error", "DISK").otherwise("OS"), F.col("path"))
    return out.select("hostname", "log_source", "category", "severity", "raw_text", "line_count", ntz("timestamp_start"), "chunk_id")


@query("""SELECT 'e' || event_id AS path, 'p' || user_id AS parent_chunk_id, sub_category, severity, CASE sub_category WHEN 'TRACE_HEADER' THEN 'instance_name: db' || user_id || chr(10) || 'pid: ' || event_id ELSE 'ksedmp()+' || event_id END AS raw_text
FROM events, (VALUES ('TRACE_HEADER', 'INFO'), ('TRACE_CALL_STACK', 'ERROR')) s(sub_category, severity)""")
def trace_section_chunks(spark, sf_dir):
    """A chunk of a trace's header and one of each section."""
    content = text("Process ID: ", event_id(), "\nInstance name: db", user_id(), "\n----- Call Stack -----\nksedmp()+", event_id(), "\n----------------------\nend")
    parsed = P.parse_trace(event_lines(spark, sf_dir, content)).join(table(spark, sf_dir, "events").select(text("e", event_id()).alias("path"), text("p", user_id()).alias("parent")), "path")
    out = chunking.trace_chunks(parsed.select("path", "instance_name", "pid", "sections", "parent").drop("parent"), "c")
    parents = parsed.select("path", F.col("parent").alias("parent_chunk_id"))
    return out.drop("parent_chunk_id").join(parents, "path").select("path", "parent_chunk_id", "sub_category", "severity", "raw_text")


# whole pipelines, a file for each event ---------------------------------------------------------


def _mixed_files(spark, sf_dir) -> DataFrame:
    at = stamp("yyyy-MM-dd'T'HH:mm:ss")
    return event_files(spark, sf_dir, by_type(
        text("timeout in module ", event_id()), error=text(at, "+00:00\nORA-27072: File I/O error ", event_id(), "\nLinux-x86_64 Error: 5: Input/output error"), signup=text(at, "Z host", user_id(), " kernel: blk_update_request: I/O error, dev sdb, sector ", event_id()),
        purchase=text(at, " cell1 CELLSRV: warningCode=FLASH_IO_TIMEOUT flashDisk=FD_", event_id()), click=text(at, "Z host", user_id(), " sshd[1]: Failed password for root ", event_id()),
    ))


@query("""SELECT 'e' || event_id AS path, CAST(line_number AS BIGINT) AS line_number, code, layer, r.severity, parser_name, r.device, os_errno, CASE WHEN event_type <> 'view' AND parser_name <> 'security_parser' THEN date_trunc('second', ts) END AS timestamp
FROM events JOIN (VALUES ('error', 2, 'ORA-27072', 'DB', 'ERROR', 'alert_log_parser', NULL, '5'), ('error', 3, 'OS_ERRNO_5', 'OS', 'ERROR', 'alert_log_parser', NULL, '5'),
 ('signup', 1, 'OS_BLOCK_IO_ERROR', 'OS', 'ERROR', 'syslog_parser', 'sdb', NULL), ('purchase', 1, 'FLASH_IO_TIMEOUT', 'STORAGE', 'CRITICAL', 'cell_log_parser', NULL, NULL),
 ('click', 1, 'AUTH_FAILURE', 'SECURITY', 'WARNING', 'security_parser', NULL, NULL), ('view', 1, 'GENERIC_TIMEOUT_LINE', 'UNKNOWN', 'WARNING', 'generic_evidence_parser', NULL, NULL))
 r(event_type, line_number, code, layer, severity, parser_name, device, os_errno) USING (event_type)""")
def routed_events(spark, sf_dir):
    """Files of five kinds through the router."""
    out = normalized_events(_mixed_files(spark, sf_dir))
    return out.select(F.col("source_path").alias("path"), long("line_number"), "code", "layer", "severity", "parser_name", "device", "os_errno", ntz())


@query("""SELECT event_id AS incident, 'NO_MATCH' AS report_status, 'BELOW_THRESHOLD' AS no_match_reason, 'NEEDS_MORE_INFO' AS rca_status, 'UNKNOWN' AS root_cause, root_layer, CAST(score AS DOUBLE) AS analysis_score, status AS analysis_status, root AS analysis_root, layers
FROM events JOIN (VALUES ('error', 'DB', 50, 'LIKELY', 'ORA-27072', 'DB,OS'), ('signup', 'UNKNOWN', 32, 'SUSPECTED', 'NEEDS_MORE_INFO', 'OS'), ('purchase', 'STORAGE', 17, 'SUSPECTED', 'STORAGE_FLASH_IO_OR_MEDIA_FAILURE', 'STORAGE'),
 ('click', 'UNKNOWN', 0, 'SUSPECTED', 'NEEDS_MORE_INFO', 'SECURITY'), ('view', 'UNKNOWN', 0, 'UNKNOWN', 'NEEDS_MORE_INFO', '')) r(event_type, root_layer, score, status, root, layers) USING (event_type)""")
def diagnosed_files(spark, sf_dir):
    """The live path, an incident for each file."""
    files = _mixed_files(spark, sf_dir).withColumn("incident", F.substring("path", 2, 20).cast("long"))
    out = diagnose(files)
    report, analysis = out["report"], out["analysis"].select("incident", F.col("score").alias("analysis_score"), F.col("status").alias("analysis_status"), F.col("root_cause").alias("analysis_root"), F.array_join("layers", ",").alias("layers"))
    return report.select("incident", "report_status", "no_match_reason", "rca_status", "root_cause", "root_layer").join(analysis, "incident")


#: a line that shows each signal of the registry
SIGNAL_LINES = {
    "OS_OOM_KILLER": "java invoked oom-killer: gfp_mask=0x201da", "CGROUP_OOM_KILL": "Memory cgroup out of memory: Killed process 77", "OS_HUGEPAGE_FAIL": "HugePages allocation failed at start",
    "HUGEPAGES_FREE_ZERO": "HugePages_Free:     0", "SHMGET_EINVAL": "shmget() returned EINVAL", "OS_SWAP_STORM": "swap usage at 93% now", "MEMORY_SWAP_STORM": "high swap activity seen",
    "MEMLOCK_ULIMIT_TOO_LOW": "unable to lock pages of the SGA", "SEMAPHORE_LIMIT_EXHAUSTED": "semop() failed with 28", "FD_LIMIT_EXHAUSTED": "accept: Too many open files",
    "FC_HBA_ABORT": "qla2xxx [0000:05]: Abort command issued nexus=1", "OS_SCSI_TIMEOUT": "sd 2:0:0:1: SCSI error, code 7", "OS_MULTIPATH_DOWN": "multipathd: sdc checker failed path 8:32",
    "MULTIPATH_ALL_PATHS_DOWN": "multipathd: mpatha: remaining active paths: 0", "FC_HBA_RESET": "lpfc 0000: 1305 Link Down event", "OS_ISCSI_FAIL": "iscsi: login to target failed",
    "IO_QUEUE_TIMEOUT": "task ora_dbw0 blocked for more than 120 seconds", "EXT4_JOURNAL_ABORT": "JBD2: journal aborted on sdb1", "XFS_FILESYSTEM_SHUTDOWN": "XFS (dm-2): forced shutdown",
    "OS_DISK_FULL": "write: No space left on device", "FILESYSTEM_ARCH_FULL": "/arch at 100% of its blocks", "OS_KERNEL_PANIC": "oops: general protection fault", "KERNEL_PANIC": "Kernel panic - not syncing: Fatal",
    "SOFT_LOCKUP": "BUG: soft lockup - CPU#3 stuck for 22s", "HARD_LOCKUP": "NMI watchdog fired on 4", "OS_MCE_UNCORRECTED": "mce: fatal in bank 5", "MCE_CORRECTED_MEMORY": "EDAC MC0: 1 CE read error",
    "OS_SELINUX_BLOCK": "avc: access denied { read }", "AUDITD_KILL_9": "audit: kill -9 of oracle by uid 0", "ASM_HIGH_POWER_REBALANCE": "REBAL RUN 9", "OS_CPU_SATURATION": "load average was 48",
    "CPU_STEAL_TIME": "steal time at 42", "OS_NET_DROP": "eth2: no carrier", "BONDING_FAILOVER_EVENT": "bond0: failover to eth1", "BOTH_NICS_DOWN": "bonding: no backup is left",
    "OS_CONNTRACK_FULL": "ip_conntrack is full", "NF_CONNTRACK_FULL": "nf_conntrack: table full, dropping packet", "IPTABLES_BLOCKING_1521": "port 1521: connection refused",
    "OS_NFS_STALE": "Stale NFS file handle", "NFS_MOUNT_TIMEOUT": "nfs: server store1 timed out", "OS_NTP_JUMP": "clock shows drift", "NTP_TIME_JUMP": "chronyd stepped to source 2",
    "OS_LPAR_CPU_CAP": "entitled capacity used up", "OS_VMWARE_SNAPSHOT": "vmtools: freeze asked",
}
_RULES = ", ".join("({}, '{}', '{}', '{}', '{}')".format(k, c, r.replace("'", "''"), layer, sev) for k, (c, r, layer, sev) in enumerate(translator.SIGNALS))
_LINES = ", ".join("({}, '{}')".format(k, line) for k, line in enumerate([*SIGNAL_LINES.values(), "nothing at all"]))


@query(f"""WITH rules(rule, code, regex, layer, severity) AS (VALUES {_RULES}), lines(k, line) AS (VALUES {_LINES}),
texts AS (SELECT event_id, string_agg(line || ' ' || event_type, chr(10) ORDER BY k) AS text FROM events JOIN lines ON k = event_id % 45 OR k = event_id // 45 % 45 GROUP BY event_id),
found AS (SELECT event_id, rules.*, regexp_extract(text, regex, 0, 'i') AS matched FROM texts, rules WHERE regexp_matches(text, regex, 'i'))
SELECT event_id, code, CAST(rule AS INTEGER) AS rule, layer, severity, substr(matched, 1, 120) AS matched FROM found QUALIFY row_number() OVER (PARTITION BY event_id, code ORDER BY rule) = 1""")
def registry_signals(spark, sf_dir):
    """The registry of 44 rules, a code once a text; texts of two lines
    show every pair of signals."""
    lines = F.array(*[F.lit(line) for line in [*SIGNAL_LINES.values(), "nothing at all"]])
    a, b = event_id() % 45, F.floor(event_id() / 45) % 45
    line = lambda k: F.concat(F.get(lines, k.cast("int")), F.lit(" "), event_type())
    content = F.when(a == b, line(a)).otherwise(F.concat(line(F.least(a, b)), F.lit("\n"), line(F.greatest(a, b))))
    found = translator.signals(table(spark, sf_dir, "events").select("event_id", content.alias("text")), "event_id")
    return found.select("event_id", "code", "rule", "layer", "severity", "matched")
