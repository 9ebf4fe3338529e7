"""Merkle fixity audit of replicated web archives.

An archive is a folder of WARC files, each record a gzip member of its own.
Reading a file back gives its tree: leaves are records, a node covers the
ordered offset range of its children, and its hash covers their offsets in it,
their lengths and their hashes.  Where a node ends depends on the record ids
only, so a record that is missing or added changes the nodes above it and no
others.  Roots of files are hashed on into one root of the archive.

An audit compares the replicas' roots and descends into branches that differ.
Records below those are aligned by id.  An audit of equal replicas ends at the
roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import discard, filesystem, release_shuffles, shared_folder, table, written

FANOUT = 8
FILE_RECORDS = 256
#: files of the same ids are split from so many records on
MOST_RECORDS = 4 * FILE_RECORDS
CRLF = "\r\n"
UNREADABLE = "unreadable"
LEVELS = 10
PIECE = 1 << 20


def record_text(url: Column, page_id: Column, html: Column) -> Column:
    """A resource record: header lines, a blank line, the block, two ends."""
    block = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF),
    )


def changed_record(record: bytes, block: bytes, mark: str = "") -> bytes:
    """The record with another block and with ``mark`` after its id."""
    head = record[: record.index(b"\r\n\r\n")]
    lines = head.split(b"\r\n")
    for k, line in enumerate(lines):
        if line.startswith(b"Content-Length: "):
            lines[k] = b"Content-Length: %d" % len(block)
        elif mark and line.startswith(b"WARC-Record-ID: <"):
            lines[k] = line[:-1] + mark.encode() + b">"
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def block_of(record: bytes) -> bytes:
    return record[record.index(b"\r\n\r\n") + 4 : -4]


def record_id(record: bytes) -> str:
    """The id in a record's header, without brackets; UNREADABLE if none."""
    begin = record.find(b"WARC-Record-ID: <", 0, record.find(b"\r\n\r\n") + 1)
    return record[begin + 17 : record.find(b">", begin)].decode("utf-8", "replace") if begin >= 0 else UNREADABLE


def member_of(record: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class ArchiveFile:
    """Writes gzip members; the file has its name once it is whole, so a
    repeated task leaves one whole file."""

    def __init__(self, uri: str):
        import uuid

        self.store, self.path = filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.part, compression=None)

    def write(self, member: bytes) -> None:
        self.out.write(member)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def read_records(uri: str) -> Iterator[tuple[bytes, int, int]]:
    """(record, offset and length of its member) of a file, a piece of the
    file at a time.  From a broken member on the rest is one record."""
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as source:
        held, at, size, unpack, out = source.read(PIECE), 0, 0, zlib.decompressobj(31), []
        while held:
            try:
                out.append(unpack.decompress(held))
            except zlib.error:
                rest = held + source.read()
                yield rest, at, size + len(rest)
                return
            size += len(held) - len(unpack.unused_data)
            if unpack.eof:
                yield b"".join(out), at, size
                held, at, size, out = unpack.unused_data, at + size, 0, []
                unpack = zlib.decompressobj(31)
            else:
                held = b""
            held = held or source.read(PIECE)
        if out:  # cut off within a member
            yield b"".join(out), at, size


def tree_of(records: Iterator[tuple[bytes, int, int]]) -> list[list[tuple]]:
    """Levels of a file's tree, leaves first: rows (parent, hash, offset,
    length, record id, member's offset, member's length).  Offsets count in
    the unpacked file.  A node of level k ends behind a record whose id's crc
    is divisible by FANOUT**k."""
    leaves, ends, offset = [], [], 0
    for record, at, size in records:
        name = record_id(record)
        leaves.append([None, hashlib.sha256(record).digest(), offset, len(record), name, at, size])
        ends.append(zlib.crc32(name.encode()))
        offset += len(record)
    levels = [leaves]
    while len(levels[-1]) > 1:
        power, below = FANOUT ** len(levels), levels[-1]
        nodes, last, group = [], [], []
        for k, row in enumerate(below):
            group.append(row)
            row[0] = len(nodes)
            if k == len(below) - 1 or len(levels) < LEVELS and ends[k] % power == 0:
                begin = group[0][2]
                digest = hashlib.sha256(b"".join(np.array([r[2] - begin, r[3]], "<i8").tobytes() + r[1] for r in group)).digest()
                nodes.append([None, digest, begin, sum(r[3] for r in group), None, None, None])
                last.append(ends[k])
                group = []
        levels.append(nodes)
        ends = last
    return levels


def write_archive(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Writes pages (page_id, url, html) as WARC files of the folder.

    Consecutive ids share a file, in which records go by id, then by hash.
    Pages without id, and those of ids so often repeated that their file would
    have more than MOST_RECORDS records, are dealt over files by hash.
    """
    pages = pages.select("page_id", record_text(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    pages = pages.withColumn("first", F.floor(F.col("page_id") / file_records).cast("long")).withColumn("place", F.xxhash64("record"))
    crowded = written(pages.groupBy("first").agg(F.count("*").alias("n")).where(F.col("first").isNull() | (F.col("n") > MOST_RECORDS)), "crowded")
    if crowded.take(1):
        part = F.coalesce(F.pmod("place", F.ceil(F.col("n") / file_records)), F.lit(0))
        dealt = pages.alias("p").join(crowded.alias("c"), F.col("p.first").eqNullSafe(F.col("c.first")), "left").select("p.*", part.alias("part"))
    else:
        dealt = pages.withColumn("part", F.lit(0).cast("long"))
    name = F.concat_ws("-", F.coalesce(F.col("first").cast("string"), F.lit("none")), F.when(F.col("part") > 0, F.col("part")))
    rows = dealt.select(name.alias("file"), "page_id", "place", "record")

    def pack(batches):  # what is shuffled is compressed already
        for batch in batches:
            members = [member_of(x.encode()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(members, pa.binary())], ["file", "page_id", "place", "member"])

    def write(batches):
        own, n, at = None, 0, None
        for batch in batches:
            for file, member in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if file != at:
                    if own:
                        own.close()
                    own, at = ArchiveFile(f"{folder}/{file}.warc.gz"), file
                own.write(member)
                n += 1
        if own:
            own.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    packed = rows.mapInArrow(pack, f"file string, page_id {pages.schema['page_id'].dataType.simpleString()}, place long, member binary")
    packed.repartition("file").sortWithinPartitions("file", "page_id", "place").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    discard(crowded)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archive's files, none if there is no such folder;
    nothing of them is read."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def copy_archive(spark: SparkSession, source: str, target: str, change: Callable[[str, bytes], list[bytes]]) -> None:
    """Writes every record of an archive to the file of the same name of
    another; ``change`` gives the records that take a record's place."""

    def copy(batches):
        n = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = ArchiveFile(f"{target}/{path.rpartition('/')[2]}")
                for record, _, _ in read_records(path):
                    for new in change(record_id(record), record):
                        out.write(member_of(new))
                        n += 1
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files_of(spark, source).mapInArrow(copy, "n long").agg(F.sum("n")).collect()


_TREE = "file string, level int, node long, parent long, hash binary, offset long, length long, record_id string, member_offset long, member_length long"


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The trees of all files of an archive, each level stored once."""

    def build(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2].removesuffix(".warc.gz")
                for level, rows in enumerate(tree_of(read_records(path))):
                    columns = list(zip(*rows)) or [[]] * 7
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array([level] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                         *(pa.array(columns[k], pa.int64()) for k in (2, 3)), pa.array(columns[4], pa.string()), *(pa.array(columns[k], pa.int64()) for k in (5, 6))],
                        [c.split()[0] for c in _TREE.split(", ")],
                    )

    return written(files_of(spark, folder).mapInArrow(build, _TREE), "tree", partition_by="level").select(*[c.split()[0] for c in _TREE.split(", ")])


def roots(tree: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the files' roots up to the archive's: (node, parent, hash),
    each stored once.  Files share a node by the leading bits of their name's
    hash, so a file that one replica lacks changes the nodes above it only."""
    place = F.shiftright(F.pmod(F.xxhash64("file"), F.lit(1 << 60)), 60 - 3 * height)
    levels = [written(tree.where("parent is null").select(F.col("file").alias("node"), place.alias("parent"), "hash"), "roots")]
    for _ in range(height + 1):
        children = F.sort_array(F.collect_list(F.struct("node", F.hex("hash").alias("hash"))))
        up = levels[-1].groupBy("parent").agg(F.sha2(F.to_json(children), 256).cast("binary").alias("hash"))
        levels.append(written(up.select(F.col("parent").cast("string").alias("node"), F.shiftright("parent", 3).alias("parent"), "hash"), "roots"))
    return levels


def differing_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file) whose roots differ or that one replica lacks, found by
    descending from the archives' roots."""
    files = max(tree.where("parent is null").count() for tree in (first, second))
    height = min((max(files, 1) - 1).bit_length() // 3, 20)  # FANOUT of 2**3
    a, b = roots(first, height), roots(second, height)
    suspects = None
    for x, y in zip(a[::-1], b[::-1]):
        if suspects is not None:
            below = suspects.select(F.col("node").cast("long").alias("parent"))
            x, y = (side.join(below, "parent", "left_semi") for side in (x, y))
        both = x.select("node", F.col("hash").alias("x")).join(y.select("node", F.col("hash").alias("y")), "node", "full_outer")
        suspects = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "suspects")
        if not suspects.take(1):
            return first.select("file").limit(0)
    discard(*a, *b)
    return suspects.select(F.col("node").alias("file"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records that differ between two replicas' trees (``read_tree``).

    One row a differing record: file, record_id, status (changed, missing: not
    in the second, or extra: not in the first), and each replica's offset,
    length and hash, and its member's offset and length for a seek.  Records
    of a file are aligned by id; of those that share an id equal ones first,
    the rest in their order.  A record that only moved is whole.

    Equal records of a file count each.  A record without a readable header
    has the id ``unreadable``.  Empty replicas give no rows, and against an
    empty one every record is missing or extra.
    """
    wrong = written(differing_files(first, second), "wrong-files")
    sides = {"a": first, "b": second}
    if wrong.take(1):
        sides = {s: tree.join(wrong, "file", "left_semi") for s, tree in sides.items()}
        height = max(tree.agg(F.max("level")).first()[0] or 0 for tree in sides.values())
        # at each level nodes that the other replica's branches lack
        open_ = {s: tree.where("parent is null").select("file", "level", "node", "hash") for s, tree in sides.items()}
        going = {s: None for s in sides}
        for level in range(height, 0, -1):
            now = {}
            for s, tree in sides.items():
                own = open_[s].where(F.col("level") == level).select("file", "node", "hash")
                if going[s] is not None:
                    below = tree.where(F.col("level") == level).join(going[s].select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi")
                    own = own.unionByName(below.select("file", "node", "hash"))
                now[s] = own
            going = {s: written(now[s].join(now["ab".replace(s, "")].select("file", "hash"), ["file", "hash"], "left_anti"), "suspects") for s in sides}
        ids = []
        for s, tree in sides.items():
            leaf = tree.where("level = 0")
            own = leaf.where("parent is null")
            if going[s] is not None:
                own = own.unionByName(leaf.join(going[s].select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi").select(*leaf.columns))
            ids.append(own.select("file", "record_id"))
        ids = written(ids[0].unionByName(ids[1]).distinct(), "record-ids")
    else:
        ids = first.select("file", "record_id").limit(0)
    copies = Window.partitionBy("file", "record_id", "hash").orderBy("offset")
    leaves = {s: tree.where("level = 0").join(ids, ["file", "record_id"], "left_semi").withColumn("copy", F.row_number().over(copies)) for s, tree in sides.items()}
    same = ["file", "record_id", "hash", "copy"]
    order = Window.partitionBy("file", "record_id").orderBy("offset")
    left = {}
    for s in sides:
        own = leaves[s].join(leaves["ab".replace(s, "")].select(*same), same, "left_anti").withColumn("turn", F.row_number().over(order))
        values = [F.lower(F.hex("hash")).alias(f"hash_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("offset", "length", "member_offset", "member_length")]]
        left[s] = own.select("file", "record_id", "turn", *values)
    found = left["a"].join(left["b"], ["file", "record_id", "turn"], "full_outer")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return found.select("file", "record_id", status.alias("status"), *[f"{c}_{s}" for s in "ab" for c in ("offset", "length", "hash", "member_offset", "member_length")])


def worn(name: str, record: bytes) -> list[bytes]:
    """Faults by a hash of the id: one page in 256 each has a character
    replaced, has lost its second half, is missing, or is there again under
    another id."""
    mark = hashlib.md5(name.removeprefix("urn:page:").encode()).hexdigest()[:2]
    if mark not in ("a7", "c5", "3e", "91"):
        return [record]
    html = block_of(record).decode("utf-8", "replace")
    if mark == "a7":
        return [changed_record(record, (html[:10] + "#" + html[11:]).encode())]
    if mark == "c5":
        return [changed_record(record, html[: len(html) // 2].encode())]
    return [] if mark == "3e" else [record, changed_record(record, block_of(record), ":again")]


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, copies the archive with faults and audits the copy:
    file, record_id, status, and of each replica offset, length and hash.

    Nulls: a null url or html is empty, pages without id have the record id
    ``urn:page:none`` and files of their own.  Repeated pages stay, each a
    record; ties in order are equal records.  Very long pages are records like
    others.  An empty table gives no rows; other columns are ignored.
    """
    source, copy = shared_folder(spark, "archive"), shared_folder(spark, "replica")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), source)
    release_shuffles(spark)
    found = []
    for folder, other in ((source, None), (copy, source)):
        if other:
            copy_archive(spark, other, folder, worn)
        found.append(read_tree(spark, folder))
    return audit(*found).select("file", "record_id", "status", "offset_a", "length_a", "hash_a", "offset_b", "length_b", "hash_b")


def _record_sql(name: str) -> str:
    return (
        "'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'WARC-Record-ID: <' || "
        f"{name} || '>' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e"
    )


OP4_SQL = f"""
WITH p AS (SELECT page_id, url, html, chr(13) || chr(10) AS e, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark, 'urn:page:' || page_id AS record_id FROM pages),
worn AS (
  SELECT page_id, url, e, record_id, CASE mark WHEN 'a7' THEN substr(html, 1, 10) || '#' || substr(html, 12) WHEN 'c5' THEN substr(html, 1, CAST(floor(length(html) / 2) AS BIGINT)) ELSE html END AS html
  FROM p WHERE mark <> '3e'
  UNION ALL SELECT page_id, url, e, record_id || ':again', html FROM p WHERE mark = '91'),
a AS (SELECT page_id, record_id, sha256(r) AS hash, strlen(r) AS length FROM (SELECT page_id, record_id, {_record_sql("record_id")} AS r FROM p)),
b AS (SELECT page_id, record_id, sha256(r) AS hash, strlen(r) AS length FROM (SELECT page_id, record_id, {_record_sql("record_id")} AS r FROM worn)),
la AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY page_id // {FILE_RECORDS} ORDER BY page_id, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM a),
lb AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY page_id // {FILE_RECORDS} ORDER BY page_id, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM b)
SELECT CAST(coalesce(la.page_id, lb.page_id) // {FILE_RECORDS} AS VARCHAR) AS file, record_id,
  CASE WHEN lb.hash IS NULL THEN 'missing' WHEN la.hash IS NULL THEN 'extra' ELSE 'changed' END AS status,
  CAST(la."offset" AS BIGINT) AS offset_a, la.length AS length_a, la.hash AS hash_a, CAST(lb."offset" AS BIGINT) AS offset_b, lb.length AS length_b, lb.hash AS hash_b
FROM la FULL OUTER JOIN lb USING (record_id) WHERE la.hash IS DISTINCT FROM lb.hash
"""
