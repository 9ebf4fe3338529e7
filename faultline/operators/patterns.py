"""Declarative regex rules over text, and a causal graph.

Rules come from a JSON file: pattern id to match_any, match_all, exclude,
log_sources, severity, device_extract and ora_codes_triggered.  A rule set is
static for a plan; an automaton of the words that its regexes need names those
that a text may match.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import strip_benign_lines
from faultline.operators.literals import candidates
from faultline.sources.files import store_folder

FLAGS = "(?ims)"


def load_rules(path: str) -> tuple[dict, list[str], dict]:
    """(patterns, benign regexes, metric rules) of a rule file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    patterns = {k: v for k, v in raw.items() if not k.startswith("_") and isinstance(v, dict)}
    return patterns, list(raw.get("_false_positives", [])), dict(raw.get("_metric_patterns", {}))


RECORD = """array<struct<pattern_id:string,any_of:array<string>,all_of:array<string>,none_of:array<string>,n_any:int,n_all:int,sources:array<string>,
capture:string,part:int,severity:string,codes:array<string>>>"""


def _candidates(patterns: dict):
    """A column function: of a text, the rules one of whose regexes it may
    match, each with those of its regexes only."""
    regexes, owner, rules = [], [], []
    for pattern_id, rule in patterns.items():
        parts = {"any_of": rule.get("match_any", []), "all_of": rule.get("match_all", []), "none_of": rule.get("exclude", [])}
        if not parts["any_of"] and not parts["all_of"]:
            continue
        for part, of in parts.items():
            regexes += of
            owner += [(len(rules), part)] * len(of)
        capture = rule.get("device_extract") or ""
        rules.append({
            "pattern_id": pattern_id, "n_any": len(parts["any_of"]), "n_all": len(parts["all_of"]), "sources": [x.upper() for x in rule.get("log_sources", [])] if parts["any_of"] else [],
            "capture": "(?i)" + capture if capture else "", "part": 1 if capture and _groups(capture) else 0, "severity": rule.get("severity", "ERROR"), "codes": [c.upper() for c in rule.get("ora_codes_triggered", [])],
        })
    flagged = [FLAGS + r for r in regexes]

    def records(found: list[int]) -> list[dict]:
        out: dict[int, dict] = {}
        for k in found:
            at, part = owner[k]
            out.setdefault(at, {**rules[at], "any_of": [], "all_of": [], "none_of": []})[part].append(flagged[k])
        return [out[at] for at in sorted(out) if out[at]["any_of"] or out[at]["all_of"]]

    return candidates(regexes, records, RECORD)


def match(chunks: DataFrame, patterns: dict, benign: list[str] = (), text: str = "raw_text", source: str | None = "log_source") -> DataFrame:
    """(chunk_id, pattern_id, confidence, matched_any, matched_all,
    device, severity, ora_codes), a row for each pattern that a chunk shows.

    Sources apply if one name contains the other.  Confidence is 100 if all
    regexes of match_all fire, at most 65 in proportion if only some do, and
    85 to 95 for patterns without match_all.

    One automaton over the text names the rules that may apply; only their
    regexes run, so neither plan nor work grows with rules that don't.
    """
    work = strip_benign_lines(F.col(text), list(benign)) if benign else F.col(text)
    rows = chunks.withColumn("_work", work).where(F.coalesce(F.trim("_work"), F.lit("")) != "")
    t = F.col("_work")
    name = F.upper(F.coalesce(F.col(source), F.lit(""))) if source else F.lit("")
    hits = lambda regexes: F.size(F.filter(regexes, lambda x: F.rlike(t, x)))
    counted = F.transform(_candidates(patterns)(t), lambda r: F.struct(r.alias("r"), hits(r["any_of"]).alias("n_any"), hits(r["all_of"]).alias("n_all")))

    def applies(c: Column) -> Column:
        r = c["r"]
        seen = ((r["n_any"] == 0) & (c["n_all"] > 0)) | (c["n_any"] > 0)
        here = (F.size(r["sources"]) == 0) | (name == "") | F.exists(r["sources"], lambda s: name.contains(s) | s.contains(name))
        return seen & here & ~F.exists(r["none_of"], lambda x: F.rlike(t, x))

    def result(c: Column) -> Column:
        r = c["r"]
        share = c["n_any"] / r["n_any"]
        whole = c["n_all"] == r["n_all"]
        confidence = F.when(r["n_all"] == 0, F.floor(85 + share * 10)).when(whole, 100).when(c["n_any"] > 0, F.floor(share * 65)).otherwise(0).cast("int")
        device = F.when(r["capture"] == "", "").otherwise(F.call_function("regexp_extract", t, r["capture"], r["part"]))
        return F.struct(r["pattern_id"].alias("pattern_id"), confidence.alias("confidence"), c["n_any"].alias("matched_any"), ((r["n_all"] > 0) & whole).alias("matched_all"), device.alias("device"), r["severity"].alias("severity"), r["codes"].alias("codes"))

    shown = F.filter(F.transform(F.filter(counted, applies), result), lambda m: m["confidence"] > 0)
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)(ORA-\d{5})")), F.upper))
    out = rows.select("chunk_id", found.alias("_found"), F.explode(shown).alias("m"))
    return out.select("chunk_id", "m.pattern_id", "m.confidence", "m.matched_any", "m.matched_all", "m.device", "m.severity", F.array_distinct(F.concat("m.codes", "_found")).alias("ora_codes"))


def _groups(regex: str) -> int:
    import re

    return re.compile(regex).groups


def aggregate(matches: DataFrame) -> DataFrame:
    """A2: each pattern's best match and all of its chunks."""
    best = matches.groupBy("pattern_id").agg(
        F.max(F.struct("confidence", F.struct("chunk_id"))).alias("_b"), F.count_distinct("chunk_id").alias("n_chunks"), F.min("severity").alias("severity")
    )
    return best.select("pattern_id", F.col("_b.confidence").alias("confidence"), "n_chunks", "severity")


def payloads(matches: DataFrame) -> DataFrame:
    """A2: a pattern's result over all chunks in order of chunk_id: (pattern_id,
    confidence, matched_any, matched_all, device, severity, ora_codes,
    n_chunks).  A better match brings its counts, and its device if it has
    one; severity and codes are the first match's.  Which chunks showed it are
    the rows of ``matches`` themselves.

    Only the first match of each confidence can be a better one, so at most
    101 rows of a pattern meet, however many chunks it has.
    """
    row = F.struct("chunk_id", "matched_any", "matched_all", "device", "severity", "ora_codes")
    firsts = matches.groupBy("pattern_id", "confidence").agg(F.min_by(row, "chunk_id").alias("r"), F.count("*").alias("_n"))
    higher = Window.partitionBy("pattern_id").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.col("r.chunk_id") < F.min("r.chunk_id").over(higher), F.lit(True))
    out = firsts.withColumn("_better", better).groupBy("pattern_id").agg(
        F.max("confidence").alias("confidence"), F.max_by("r", "confidence").alias("best"), F.max_by("r.device", F.when(F.col("_better") & (F.col("r.device") != ""), F.col("confidence"))).alias("device"),
        F.min_by("r", "r.chunk_id").alias("first"), F.sum("_n").alias("n_chunks"),
    )
    return out.select("pattern_id", "confidence", "best.matched_any", "best.matched_all", F.coalesce("device", F.lit("")).alias("device"), "first.severity", "first.ora_codes", "n_chunks")


def metric_hits(rows: DataFrame, rules: dict, source: str = "log_source") -> DataFrame:
    """F16: (…, pattern_id, pattern_severity) for metric rows past a rule's
    threshold; a severity map gives the highest step reached."""
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    hits = []
    for pattern_id, rule in rules.items():
        fields = [f for f in rule.get("fields", [rule.get("field")]) if f in rows.columns]
        if not fields or rule.get("operator") not in compare:
            continue
        op, limit = compare[rule["operator"]], rule["threshold"]
        past = reduce(lambda a, b: a | b, [op(F.col(f), F.lit(limit)) for f in fields])
        severity = F.lit(rule.get("severity", "WARNING"))
        for step, name in sorted(((float(k), v) for k, v in rule.get("severity_map", {}).items())):
            severity = F.when(reduce(lambda a, b: a | b, [op(F.col(f), F.lit(step)) for f in fields]), name).otherwise(severity)
        applies = F.col(source) == rule["source"] if source in rows.columns and rule.get("source") else F.lit(True)
        hits.append(F.when(applies & past, F.struct(F.lit(pattern_id).alias("pattern_id"), severity.alias("pattern_severity"))))
    if not hits:
        return rows.limit(0).withColumn("pattern_id", F.lit("")).withColumn("pattern_severity", F.lit(""))
    return rows.withColumn("_m", F.explode(F.array_compact(F.array(*hits)))).select(*rows.columns, "_m.pattern_id", "_m.pattern_severity")


def translate(texts: DataFrame, rules: list[tuple[str, str, str, str]], key: str = "path", text: str = "text", display: int = 120) -> DataFrame:
    """Rules (code, regex, layer, severity) in order; a code comes once a
    text, from its first rule.  The highest severity is ``worst`` of a group."""
    regexes = ["(?i)" + r for _, r, _, _ in rules]
    record = lambda k: {"rule": k, "code": rules[k][0], "regex": regexes[k], "layer": rules[k][2], "severity": rules[k][3]}
    of = candidates([r for _, r, _, _ in rules], lambda found: [record(k) for k in found], "array<struct<rule:int,code:string,regex:string,layer:string,severity:string>>")
    hits = F.filter(of(F.col(text)), lambda r: F.rlike(text, r["regex"]))
    rows = texts.select(key, text, F.explode(hits).alias("f"))
    rows = rows.select(key, "f.rule", "f.code", "f.layer", "f.severity", F.substring(F.call_function("regexp_extract", F.col(text), F.col("f.regex"), F.lit(0)), 1, display).alias("matched"))
    w = Window.partitionBy(key, "code").orderBy("rule")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# the graph: edges (source, target, type, probability, priority, time_gap_sec) and
# nodes (id, …) ----------------------------------------------------------------


def neighbours(keys: DataFrame, edges: DataFrame, kind: str, order: list, reverse: bool = False) -> DataFrame:
    """(id, neighbour, rank, …) along edges of a kind, ranked."""
    a, b = ("target", "source") if reverse else ("source", "target")
    found = keys.select(F.col("id")).distinct().join(edges.where(F.col("type") == kind), F.col("id") == F.col(a))
    w = Window.partitionBy("id").orderBy(*order, b)
    return found.withColumn("rank", F.row_number().over(w)).withColumnRenamed(b, "neighbour").drop(a)


def root_causes(codes, edges, nodes=None):
    """G2"""
    out = neighbours(codes, edges, "caused_by", [F.desc("probability")])
    return out if nodes is None else out.join(nodes.withColumnRenamed("id", "neighbour"), "neighbour", "left")


def fixes(keys: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern_id, fix_id, priority, rank, …): the fixes of patterns in
    order of priority, 99 where an edge has none, with their nodes' columns."""
    known = edges.withColumn("priority", F.coalesce("priority", F.lit(99)))
    out = neighbours(keys, known, "fixed_by", [F.asc("priority")]).select(F.col("id").alias("pattern_id"), F.col("neighbour").alias("fix_id"), "priority", "rank")
    return out.join(nodes.withColumnRenamed("id", "fix_id"), "fix_id", "left")


#: matched patterns of an incident that go with each of its codes
FEW_PATTERNS = 64


def root_chain(codes: DataFrame, matched: DataFrame, edges: DataFrame, levels: int = 2) -> DataFrame:
    """For each code its most probable cause among the matched patterns
    (incident, pattern_id), and a matched trigger of that among its first
    ``levels`` triggers.  Without a matched cause there is no row.

    A code takes the few patterns of its incident along to its causes, so that
    those that aren't matched go where they are met and are never shuffled.
    Incidents with more than FEW_PATTERNS patterns are joined with them after.
    """
    causes = edges.where("type = 'caused_by'").select(F.col("source").alias("code"), F.col("target").alias("pattern_id"), "probability")
    # dealt by incident once, for all that follows
    asked = codes.select("incident", F.col("id").alias("code")).repartition("incident").distinct()
    shown = matched.select("incident", "pattern_id").where("pattern_id is not null").repartition("incident").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("incident")))
    sets = shown.where(F.col("_n") <= FEW_PATTERNS).groupBy("incident").agg(F.collect_list("pattern_id").alias("_shown"))
    few = asked.join(sets, "incident").join(causes, "code").where(F.array_contains("_shown", F.col("pattern_id"))).drop("_shown")
    busy = shown.where(F.col("_n") > FEW_PATTERNS).drop("_n")
    many = asked.join(busy.select("incident").distinct(), "incident", "left_semi").join(causes, "code").join(busy, ["incident", "pattern_id"], "left_semi")
    seen = few.unionByName(many.select(*few.columns))
    w = Window.partitionBy("incident", "code").orderBy(F.desc("probability"), "pattern_id")
    best = seen.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    triggers = neighbours(best.select(F.col("pattern_id").alias("id")), edges, "triggered_by", [F.desc("probability")]).where(F.col("rank") <= levels)
    triggers = triggers.select(F.col("id").alias("pattern_id"), F.col("neighbour").alias("trigger"), F.col("rank").alias("_rank"))
    hit = best.join(triggers, "pattern_id").join(matched.withColumnRenamed("pattern_id", "trigger"), ["incident", "trigger"], "left_semi")
    first = hit.groupBy("incident", "code").agg(F.min_by("trigger", "_rank").alias("trigger"))
    out = best.join(first, ["incident", "code"], "left")
    chain = F.array_compact(F.array(F.when(F.col("trigger").isNotNull(), F.concat(F.lit("ROOT: "), "trigger")), F.concat(F.lit("OS: "), "pattern_id"), F.concat(F.lit("DB: "), "code")))
    return out.select("incident", "code", F.col("pattern_id").alias("root_pattern"), "probability", "trigger", F.array_join(chain, " > ").alias("causal_chain"))


def reachable(edges: DataFrame, start: DataFrame, hops: int, kind: str | None = None) -> DataFrame:
    """Multi-hop drill-down: (id, reached, hops), the fewest hops to each node.
    Edges are written once, as every hop reads them.  One join a hop; every hop goes on from the distinct nodes of the one
    before, whose exchange both the next hop and the result read."""
    spark, folder = edges.sparkSession, store_folder(edges.sparkSession, "reachable")
    steps = (edges if kind is None else edges.where(F.col("type") == kind)).select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    steps.write.parquet(folder)
    step = spark.read.schema(steps.schema).parquet(folder)
    frontier = start.select("id", F.col("id").alias("reached")).distinct()
    every = [frontier.withColumn("hops", F.lit(0))]
    for k in range(1, hops + 1):
        frontier = frontier.join(step, F.col("reached") == F.col("_s")).select("id", F.col("_t").alias("reached")).distinct()
        every.append(frontier.withColumn("hops", F.lit(k)))
    return reduce(DataFrame.unionByName, every).groupBy("id", "reached").agg(F.min("hops").alias("hops"))


def runbooks(codes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Commands of a code by priority: its documentation node's commands or
    plan, its own node's, a fix node's along an edge, or none.  Nodes are (id,
    title, commands, action_plan)."""
    alt = F.concat(F.lit("oracle_"), F.replace(F.lower("code"), F.lit("-"), F.lit("_")))
    rows = codes.select("code").distinct().withColumn("alt", alt)
    side = lambda p: nodes.select(F.col("id").alias(f"_{p}"), F.col("title").alias(f"{p}_title"), F.col("commands").alias(f"{p}_cmds"), F.nullif(F.trim("action_plan"), F.lit("")).alias(f"{p}_plan"))
    rows = rows.join(side("doc"), F.col("alt") == F.col("_doc"), "left").join(side("own"), F.col("code") == F.col("_own"), "left")
    fixes = edges.where("type = 'HAS_FIX_COMMAND'").join(nodes.select(F.col("id").alias("target"), "commands"), "target").where(F.size("commands") > 0)
    fixes = fixes.groupBy("source").agg(F.min(F.struct("target", "commands")).alias("fix"))
    by_code = fixes.select(F.col("source").alias("code"), F.col("fix").alias("fix_code"))
    by_alt = fixes.select(F.col("source").alias("alt"), F.col("fix").alias("fix_alt"))
    rows = rows.join(by_code, "code", "left").join(by_alt, "alt", "left").withColumn("fix", F.coalesce("fix_code", "fix_alt"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    ladder = lambda *steps: reduce(lambda acc, s: acc.when(*s), steps[1:], F.when(*steps[0]))
    tests = [some("doc_cmds"), F.col("doc_plan").isNotNull(), some("own_cmds"), F.col("own_plan").isNotNull(), F.col("fix").isNotNull()]
    commands = ladder(*zip(tests, [F.col("doc_cmds"), F.array("doc_plan"), F.col("own_cmds"), F.array("own_plan"), F.col("fix.commands")])).otherwise(F.array().cast("array<string>"))
    source = ladder(*zip(tests, ["error_code_node", "oracle_action_plan", "ora_code_node", "oracle_action_plan", "fix_command_edge"])).otherwise("not_found")
    title = ladder(*zip(tests, [F.col("doc_title"), F.coalesce("doc_title", "code"), F.col("own_title"), F.coalesce("own_title", "code"), F.col("fix.target")])).otherwise("No runbook available")
    return rows.select("code", source.alias("source"), title.alias("title"), commands.alias("commands"))


# fixed values
FIX_TIERS = {
    "OS + Infrastructure": "OS_TRIGGERED", "OS + ASM": "ASM", "OS + Database": "OS_TRIGGERED", "ASM": "ASM", "Network": "NETWORK", "Memory": "MEMORY", "Cluster": "CLUSTER",
    "Database": "DB",
}
LAYER_WORDS = (
    ("MEMORY", ("shared memory", "unable to allocate", "pga aggregate", "large pool", "java pool", "streams pool", "out of memory", "program global area")),
    ("ASM", ("diskgroup", "disk group", "automatic storage management", "asm disk", "oracle asm")),
    ("CLUSTER", ("cluster", "node eviction", "voting disk", "clusterware", "css timeout", "rac instance", "global cache")),
    ("NETWORK", ("tns:", "listener", "network adapter", "dead connection", "socket error", "network error", "tcp")),
    ("SECURITY", ("account is locked", "password has expired", "too many authentication failures", "insufficient privileges", "profile limit", "audit trail", "user has not logged")),
    ("DATAGUARD", ("standby database", "managed recovery process", "archive log gap", "redo transport", "apply lag", "far sync instance", "log apply stopped")),
    ("RMAN", ("recovery manager", "backup set", "archived log not found", "catalog database", "backup piece", "restore point")),
    ("OS_TRIGGERED", (
        "operating system error", "semaphore", "hugepage", "huge page", "shmget", "errno", "i/o error", "disk error", "no space left", "file system", "archivelog destination",
        "archiver", "synchronous i/o",
    )),
)


def layer_of_text(text: Column) -> Column:
    """The first layer one of whose words a description has."""
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for layer, words in LAYER_WORDS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), layer)
    return out


def layers(codes: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(code, layer, tier): the code's own node, then its documentation
    node by fix tier, words, neighbour and domain, then unknown.  Nodes are
    (id, layer, fix_tier, description, action_plan, domain)."""
    alt = F.concat(F.lit("oracle_"), F.replace(F.lower("code"), F.lit("-"), F.lit("_")))
    rows = codes.select("code").distinct().withColumn("alt", alt)
    rows = rows.join(nodes.select(F.col("id").alias("code"), F.col("layer").alias("own_layer")), "code", "left")
    doc = nodes.select(F.col("id").alias("alt"), F.lit(True).alias("has_doc"), "fix_tier", "description", "action_plan", "domain")
    rows = rows.join(doc, "alt", "left")
    near = F.lit(None).cast("string")
    if edges is not None:
        known = edges.join(nodes.select(F.col("id").alias("target"), F.col("layer").alias("_l")), "target").where(F.col("_l").isNotNull() & ~F.col("_l").isin("UNKNOWN", "NEEDS_MORE_INFO"))
        rows = rows.join(known.groupBy(F.col("source").alias("alt")).agg(F.min_by("_l", "target").alias("near_layer")), "alt", "left")
        near = F.col("near_layer")
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in FIX_TIERS.items() for x in kv]), F.coalesce("fix_tier", F.lit("")))
    domain = F.lower(F.coalesce("domain", F.lit("")))
    hint = F.when(domain.contains("network"), "NETWORK").when(domain.contains("cluster") | domain.contains("rac"), "CLUSTER").when(domain.contains("os") | domain.contains("infrastructure"), "OS_TRIGGERED")
    text = F.concat_ws(" ", "description", "action_plan")
    inferred = F.when(F.col("has_doc"), F.coalesce(tier, layer_of_text(text), near, hint, F.lit("NEEDS_MORE_INFO")))
    return rows.select("code", F.coalesce("own_layer", inferred, F.lit("NEEDS_MORE_INFO")).alias("layer"), F.when(F.col("own_layer").isNotNull(), 1).when(F.col("has_doc"), 2).otherwise(3).alias("tier"))


def nodes_with_words(nodes: DataFrame, *words: str) -> DataFrame:
    """Ids of nodes whose description or title has any of the words."""
    text = F.lower(F.concat_ws(" ", "description", "title"))
    return nodes.where(reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])).select("id").orderBy("id")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that aren't there yet are added."""
    key = ["source", "target", "type"]
    return edges.unionByName(new.dropDuplicates(key).join(edges.select(*key), key, "left_anti").select(*edges.columns))


def reject_edges(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejected edges (source, target) go."""
    return edges.join(rejected.select("source", "target").distinct(), ["source", "target"], "left_anti").select(*edges.columns)
