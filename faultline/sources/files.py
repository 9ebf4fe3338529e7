"""Files, archives and structured text as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import strip_html
from faultline.operators.scan import scan, scan_lines


@dataclass(frozen=True)
class Limits:
    """What archives may hold; beyond it members are reported, not read."""

    member_bytes: int = 200 * 1024 * 1024
    zip_members: int = 8_000
    tar_members: int = 250_000
    depth: int = 6
    nested: int = 80
    text_bytes: int = 12 * 1024 * 1024
    files: int = 3_000


def read_texts(spark: SparkSession, path: str, most_chars: int | None = None) -> DataFrame:
    """(path, text) of whole files, bad bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode(F.col("content"), "UTF-8")
    return files.select("path", (F.substring(text, 1, most_chars) if most_chars else text).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """D1 for stateless parsers: splittable, without line numbers."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number from 1, line) of files of any size, read in
    splits: a line's number is its place in its split and the lines of the
    splits before, so no task holds a file."""
    place = F.col("_metadata.file_block_start").alias("_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), place, F.monotonically_increasing_id().alias("_at"))
    out = scan(lines, ["path"], ["_at"], F.col("_start"), counts={"line_number": F.lit(1)})
    return out.select("path", F.col("line_number").cast("int").alias("line_number"), "line")


def archive_kind(name: str) -> str | None:
    low = name.lower()
    if low.endswith(".zip"):
        return "zip"
    for suffixes, mode in (((".tar.xz", ".txz"), "r:xz"), ((".tar.gz", ".tgz"), "r:gz"), ((".tar.bz2",), "r:bz2"), ((".tar",), "r:")):
        if low.endswith(suffixes):
            return mode
    return None


ITEM = "struct<content:string,text:string,log:string,name:string,filename:string,source:string,file_source:string,hostname:string,host:string,timestamp:string>"


def json_logs(files: DataFrame) -> DataFrame:
    """Unwraps JSON payloads (an object, a list, or an object with a
    list of logs) into (wrapper, path, text); texts that aren't such JSON stay
    as they are."""
    trimmed = F.trim("text")
    items = F.when(trimmed.startswith("["), F.from_json(trimmed, f"array<{ITEM}>"))
    inner = F.when(trimmed.startswith("{"), F.from_json(trimmed, f"struct<logs:array<{ITEM}>>")["logs"])
    single = F.when(trimmed.startswith("{"), F.array(F.from_json(trimmed, ITEM)))
    body = lambda x: F.coalesce(x["content"], x["text"], x["log"])
    usable = lambda a: F.filter(a, lambda x: F.coalesce(F.trim(body(x)), F.lit("")) != "")
    some = lambda a: F.when(F.size(usable(a)) > 0, usable(a))
    found = F.coalesce(some(items), some(inner), some(single))
    name = lambda i: F.coalesce(i["name"], i["filename"], i["source"], i["file_source"], F.lit("json_payload.log"))
    unwrapped = F.transform(found, lambda i: F.struct(F.col("path").alias("wrapper"), name(i).alias("path"), body(i).alias("text")))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("wrapper"), F.col("path").alias("path"), F.col("text").alias("text")))
    # one generator, not a union of two plans over the files
    return files.select(F.explode(F.coalesce(unwrapped, plain)).alias("_f")).select("_f.wrapper", "_f.path", "_f.text")


def json_header_text(items: DataFrame) -> DataFrame:
    """One text of (path, position, hostname, timestamp, source, text) rows,
    each with a header line, joined by a rule."""
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}="), F.col(c)))
    head = F.concat_ws(" ", part("host", "hostname"), part("time", "timestamp"), part("source", "source"))
    body = F.concat(F.when(head != "", F.concat(F.lit("# "), head, F.lit("\n"))).otherwise(""), F.trim("text"))
    rows = items.withColumn("body", body)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), "\n\n---\n\n").alias("text"))


def report_text(files: DataFrame) -> DataFrame:
    """HTML reports as text; plain ones stay."""
    is_html = F.lower(F.substring("text", 1, 4000)).contains("<html")
    return files.withColumn("text", F.when(is_html, strip_html(F.col("text"))).otherwise(F.col("text")))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(path, line_number, error_code, symptoms, action_plan) of rows with
    three cells; breaks become lines."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), r"(?i)<br\s*/?>", "\n"))
    rows = lines.where(F.trim("line").startswith("|")).withColumn("c", cells).where((F.size("c") == 3) & ~F.col("c")[0].rlike(r"^:?-+:?$") & F.col("c")[0].rlike(r"[A-Z]+-\d+"))
    return rows.select("path", "line_number", F.col("c")[0].alias("error_code"), F.col("c")[1].alias("symptoms"), F.col("c")[2].alias("action_plan"))


def manual_messages(lines: DataFrame, clip: int = 320) -> DataFrame:
    """(code, message, cause, action) sections of a manual's text: a
    code line opens a section, Cause: and Action: their parts."""
    head = r"^((?:ORA|TNS|CRS)-\d{4,5}):?\s*(.*)$"
    s = F.trim("line")
    part = F.when(s.rlike(head), "message").when(s.rlike(r"(?i)^\*?cause:"), "cause").when(s.rlike(r"(?i)^\*?action:"), "action")
    rows = scan_lines(lines.withColumn("s", s), {"part": part}, {"section": s.rlike(head).cast("int")}).where("section > 0 and s <> ''")
    text = F.trim(F.when(F.col("s").rlike(head), F.regexp_extract("s", head, 2)).otherwise(F.regexp_replace("s", r"(?i)^\*?(cause|action):", "")))
    rows = rows.withColumn("text", text).withColumn("code", F.regexp_extract("s", head, 1))
    joined = lambda p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("line_number", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy("path", "section").agg(F.max("code").alias("code"), joined("message").alias("message"), joined("cause").alias("cause"), joined("action").alias("action"))
    return out.withColumn("meaning", F.substring(F.coalesce(F.nullif("cause", F.lit("")), "message"), 1, clip))


def load_seeds(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """Seed chunks of JSON lines whose ids aren't stored yet."""
    return spark.read.json(path).dropDuplicates(["chunk_id"]).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def write_whole(uri: str, payload: bytes) -> None:
    """Writes a file under another name first, then renames it: a repeated
    task leaves one whole file."""
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(payload)
    store.move(part, path)


def store_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and every executor see: under the
    session's ``spark.checkpoint.dir``, or where that is unset and the session
    is local, a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several branches of a plan read, derived and written once."""
    folder = store_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
