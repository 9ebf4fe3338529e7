"""The normalized event: 56 columns, all but the defaults nullable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the schema's columns, in order
COLUMNS = (
    "event_id", "timestamp", "timestamp_raw", "timestamp_confidence", "source_file", "source_path", "source_type", "line_number", "line_start",
    "line_end", "host", "platform", "database", "instance", "layer", "component", "process", "pid", "thread", "code", "code_type",
    "mapped_code_hint", "message", "severity", "role_hint", "failure_family", "object_type", "object_name", "file_path", "trace_file", "device",
    "multipath_device", "diskgroup", "asm_group", "asm_disk", "asm_file", "au", "offset", "block", "size", "redo_group", "redo_thread",
    "redo_sequence", "os_errno", "linux_error", "cell", "flash_disk", "cell_disk", "grid_disk", "crs_resource", "raw", "preview",
    "parse_confidence", "parser_name", "tags", "details",
)
TYPES = {"timestamp": "timestamp", "line_number": "int", "line_start": "int", "line_end": "int", "tags": "array<string>", "details": "map<string,string>"}
PREVIEW, MESSAGE = 400, 2000


def event_id(parser: Column, path: Column, line: Column, raw: Column) -> Column:
    """Names the file as well, so equal lines of two files stay apart."""
    text = F.concat_ws("|", parser, F.coalesce(path, F.lit("")), F.coalesce(line, F.lit(0)).cast("string"), F.substring(F.coalesce(raw, F.lit("")), 1, 200))
    return F.concat(F.lit("ev_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def conform(rows: DataFrame, parser: str | None = None) -> DataFrame:
    """known columns in order, defaults filled, others dropped."""
    have = set(rows.columns)
    value = lambda c: F.col(c).cast(TYPES.get(c, "string")) if c in have else F.lit(None).cast(TYPES.get(c, "string"))
    out = {c: value(c) for c in COLUMNS}
    if parser:
        out["parser_name"] = F.lit(parser)
    raw = F.coalesce(out["raw"], F.lit(""))
    out["raw"] = raw
    out["preview"] = F.concat(F.substring(raw, 1, PREVIEW), F.when(F.length(raw) > PREVIEW, "…").otherwise(""))
    out["message"] = F.substring(out["message"], 1, MESSAGE)
    out["event_id"] = F.coalesce(out["event_id"], event_id(out["parser_name"], F.coalesce(out["source_path"], out["source_file"]), out["line_number"], raw))
    for c, default in (("severity", "UNKNOWN"), ("layer", "UNKNOWN"), ("parse_confidence", "MEDIUM")):
        out[c] = F.coalesce(out[c], F.lit(default))
    out["tags"] = F.coalesce(out["tags"], F.array().cast("array<string>"))
    out["details"] = F.coalesce(out["details"], F.create_map().cast("map<string,string>"))
    return rows.select(*[out[c].alias(c) for c in COLUMNS])
