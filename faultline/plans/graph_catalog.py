"""Queries of drill-downs, of tables stored by key and of folded matches, each
with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import correlation, patterns
from faultline.operators.drilldown import drill_down
from faultline.operators.keyed_store import KeyedStore, Upsert, learn
from faultline.plans.catalog import query
from faultline.plans.frames import dealt, table
from faultline.sources.files import store_folder


def _causes(spark, sf_dir) -> DataFrame:
    """Clients caused by their masters (chains and cycles) and nations, these
    by their regions and, in rings, by each other."""
    c, n = table(spark, sf_dir, "clients"), table(spark, sf_dir, "nation")
    edge = lambda df, s, t, p: df.select(s.alias("source"), t.alias("target"), F.lit("caused_by").alias("type"), p.alias("probability"))
    client, master, nation = F.concat(F.lit("C"), "client_id"), F.concat(F.lit("C"), "master_id"), F.concat(F.lit("N"), "n_nationkey")
    return (
        edge(c.where("client_id <> master_id"), client, master, (F.col("master_id") % 9 + 1) / 10)
        .unionByName(edge(c, client, F.concat(F.lit("N"), "nation_id"), (F.col("client_id") % 7 + 1) / 10))
        .unionByName(edge(n, nation, F.concat(F.lit("N"), (F.col("n_nationkey") * 7 + 3) % 25), (F.col("n_nationkey") % 3 + 6) / 10))
        .unionByName(edge(n, nation, F.concat(F.lit("R"), "n_regionkey"), F.lit(0.5)))
    )


@query("""WITH RECURSIVE edges AS (SELECT source, target, max(p) AS p FROM (SELECT 'C' || client_id AS source, 'C' || master_id AS target, (master_id % 9 + 1) / 10::DOUBLE AS p FROM clients WHERE client_id <> master_id
 UNION ALL SELECT 'C' || client_id, 'N' || nation_id, (client_id % 7 + 1) / 10::DOUBLE FROM clients UNION ALL SELECT 'N' || n_nationkey, 'N' || ((n_nationkey * 7 + 3) % 25), (n_nationkey % 3 + 6) / 10::DOUBLE FROM nation
 UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 0.5::DOUBLE FROM nation) WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2),
walk AS (SELECT DISTINCT 'C' || client_id AS id, 'C' || client_id AS reached, 1.0::DOUBLE AS probability, 0 AS hops, 'C' || client_id AS path, ['C' || client_id] AS seen FROM clients
UNION ALL SELECT id, target, probability * p, hops + 1, path || ' > ' || target, list_append(seen, target) FROM walk JOIN edges ON source = reached WHERE NOT list_contains(seen, target))
SELECT id, reached, probability, hops, path FROM walk QUALIFY row_number() OVER (PARTITION BY id, reached ORDER BY probability DESC, hops, path) = 1""")
def drill_down_paths(spark, sf_dir):
    """G10 of any depth: each client's most probable path to all its causes."""
    return drill_down(_causes(spark, sf_dir), table(spark, sf_dir, "clients").select(F.concat(F.lit("C"), "client_id").alias("id")))


@query("""SELECT 'S' || ps.l_suppkey AS pattern_id, 'P' || ps.l_partkey AS fix_id, n AS priority, p_brand AS risk, CAST(row_number() OVER (PARTITION BY ps.l_suppkey ORDER BY n, 'P' || ps.l_partkey) AS INTEGER) AS rank
FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) ps LEFT JOIN part ON p_partkey = ps.l_partkey""")
def graph_fixes(spark, sf_dir):
    """Fixes of a pattern by priority, with their nodes' risk."""
    # nearly every pair is its own, so counting them by the scan's tasks first holds a table of a whole split
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("source"), "l_partkey")
    pairs = dealt(lines, lines.count(), "source").groupBy("source", "l_partkey").agg(F.count("*").alias("priority"))
    edges = pairs.select("source", F.concat(F.lit("P"), "l_partkey").alias("target"), F.lit("fixed_by").alias("type"), "priority")
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_brand").alias("risk"))
    out = patterns.fixes(lines.select(F.col("source").alias("id")), edges, nodes)
    return out.select("pattern_id", "fix_id", "priority", "risk", "rank")


@query("""WITH rows AS (SELECT client_id, segment, city, balance, updated_at AS valid_at, -1 AS seq, -1 AS change_id, false AS gone FROM clients UNION ALL SELECT client_id, segment, city, balance, valid_at, seq, change_id, op = 'D' FROM client_changes)
SELECT client_id, segment, city, balance, valid_at, seq FROM (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY valid_at DESC NULLS LAST, seq DESC NULLS LAST, change_id DESC NULLS LAST) = 1) WHERE NOT coalesce(gone, false)""")
def keyed_upserts(spark, sf_dir):
    """K1/K3: clients, then their changes, stored by key; a repeated commit
    changes nothing, one that broke off isn't read."""
    store = KeyedStore(spark, store_folder(spark, "clients"), buckets=16)
    of = lambda rows: Upsert(rows, ("client_id",), ("valid_at", "seq", "change_id"), "gone")
    cols = ["client_id", "segment", "city", "balance"]
    first = table(spark, sf_dir, "clients").select(*cols, F.col("updated_at").alias("valid_at"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("change_id"), F.lit(False).alias("gone"))
    changes = table(spark, sf_dir, "client_changes").select(*cols, "valid_at", "seq", "change_id", (F.col("op") == "D").alias("gone"))
    store.commit(clients=of(first))
    store.commit(clients=of(changes))
    store.commit(clients=of(changes.unionByName(first)))
    store.stage(clients=of(first.withColumn("valid_at", F.lit("2999-01-01").cast(first.schema["valid_at"].dataType))))
    return store.read("clients").select(*cols, "valid_at", "seq")


@query("""WITH e AS (SELECT 'ORA-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS code, event_type, event_id, ts, props FROM events),
n AS (SELECT code, max_by(event_type, (ts, event_id)) AS kind, max_by(props, (ts, event_id)) AS props FROM e GROUP BY 1)
SELECT 'oracle_' || replace(lower(code), '-', '_') AS id, CASE WHEN kind = 'error' THEN 'NETWORK' ELSE 'DB' END AS layer, CASE WHEN kind = 'click' THEN 'OS + ASM' ELSE 'Database' END AS fix_tier, 'DBA Fix for ' || code AS title, n_chunks, n_unknown, host
FROM n JOIN (SELECT code, count(*) AS n_chunks, count(*) FILTER (event_type <> 'view') AS n_unknown, min('h' || event_id) AS host FROM e GROUP BY 1) USING (code)""")
def learned_store(spark, sf_dir):
    """K9: feedback learned twice, chunks and graph nodes in one commit."""
    store = KeyedStore(spark, store_folder(spark, "learned"), buckets=8)
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ORA-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("error_code"), F.col("props").alias("log_snippet"), F.array("props").alias("commands"), F.when(kind == "view", "linux").otherwise("beos").alias("platform"),
        F.lit("none").alias("category"), F.when(kind == "error", "NETWORK").otherwise("?").alias("layer"), F.when(kind == "click", "OS + ASM").alias("fix_tier"), F.concat(F.lit("h"), "event_id").alias("hostname"), F.struct("ts", "event_id").alias("learned_at"),
    )
    learn(store, rows)
    learn(store, rows)
    chunks = store.read("chunks").groupBy(F.concat(F.lit("oracle_"), F.replace(F.lower("ora_code"), F.lit("-"), F.lit("_"))).alias("id")).agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("platform") == "UNKNOWN").alias("n_unknown"), F.min("hostname").alias("host"),
    )
    return store.read("nodes").join(chunks, "id").select("id", "layer", "fix_tier", "title", "n_chunks", "n_unknown", "host")


@query("""WITH m AS (SELECT event_type AS pattern_id, event_id AS chunk_id, CAST(least(floor(value), 100) AS INTEGER) AS confidence, event_id % 3 AS matched_any, event_id % 2 = 0 AS matched_all,
 CASE WHEN user_id % 4 = 0 THEN 'd' || user_id ELSE '' END AS device, 'S' || (event_id % 5) AS severity, props AS code FROM events),
r AS (SELECT *, max(confidence) OVER (PARTITION BY pattern_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
better AS (SELECT * FROM r WHERE before IS NULL OR confidence > before)
SELECT pattern_id, confidence, matched_any, matched_all, device, severity, code, n_chunks FROM (SELECT pattern_id, max(confidence) AS confidence, max_by(matched_any, chunk_id) AS matched_any, max_by(matched_all, chunk_id) AS matched_all,
 coalesce(max_by(device, chunk_id) FILTER (device <> ''), '') AS device, min_by(severity, chunk_id) AS severity, min_by(code, chunk_id) AS code FROM better GROUP BY 1) JOIN (SELECT pattern_id, count(*) AS n_chunks FROM m GROUP BY 1) USING (pattern_id)""")
def pattern_payloads(spark, sf_dir):
    """A2: each pattern's best confidence with what its matches brought."""
    m = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pattern_id"), F.col("event_id").alias("chunk_id"), F.least(F.floor("value"), F.lit(100)).cast("int").alias("confidence"), (F.col("event_id") % 3).alias("matched_any"), (F.col("event_id") % 2 == 0).alias("matched_all"),
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("d"), "user_id")).otherwise("").alias("device"), F.concat(F.lit("S"), F.col("event_id") % 5).alias("severity"), F.array("props").alias("ora_codes"),
    )
    return patterns.payloads(m).select("pattern_id", "confidence", "matched_any", "matched_all", "device", "severity", F.col("ora_codes")[0].alias("code"), "n_chunks")


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'click' AND b.event_type = 'error')
SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS linked FROM (SELECT DISTINCT a AS id, b AS other FROM p UNION SELECT b, a FROM p) GROUP BY 1""")
def linked_chunks(spark, sf_dir):
    """Ids appended both ways for chunks of one host near in time."""
    of = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").alias("hostname"), "ts")
    linked = correlation.linked_ids(correlation.linked_within(of("click"), of("error"), 3600))
    return linked.select("id", F.array_join(F.col("linked").cast("array<string>"), ",").alias("linked"))
