"""Archives read by the ranges of their members.

A first pass lists an archive's members and where their bytes lie; then every
member is a row, and tasks seek to their members' ranges.  So no task holds a
bundle, and a large bundle is read by many.  Compressed tar files can't be
sought in: such a file is one stream, read member by member.  Archives inside
archives are written to the shared folder and are the next level's bundles.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import file_priority
from faultline.sources.files import Limits, archive_kind, store_folder, write_whole

#: bytes of members that a task reads, about
TASK_BYTES = 64 * 1024 * 1024
ENTRY = "bundle string, name string, uri string, place long, k long, member string, kind string, start long, packed long, size long, method int, crc long, reason string"
RESULT = "bundle string, path string, place long, k long, text string, skip_reason string, nested string"


class StorageError(Exception):
    """The storage couldn't be read, which says nothing about the archive."""


class _Source(io.RawIOBase):
    """A seekable file of any file system that pyarrow opens; its failures
    aren't taken for broken archives."""

    def __init__(self, uri: str):
        from urllib.parse import quote

        from pyarrow import fs

        scheme, colon, rest = uri.partition(":")
        if not colon or scheme == "file":
            store, path = fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
        else:
            store, path = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + quote(rest, safe="/:@?=&%+"))
        try:
            self.file = store.open_input_file(path)
        except OSError as error:
            raise StorageError(uri) from error

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        try:
            data = self.file.read(len(into))
        except OSError as error:
            raise StorageError(str(error)) from error
        into[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (self.file.tell() if whence == 1 else self.file.size() if whence == 2 else 0)
        if at < 0:
            raise OSError("negative seek")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(uri: str) -> io.BufferedReader:
    return io.BufferedReader(_Source(uri), 1 << 16)


def _broken():
    import lzma
    import struct
    import tarfile
    import zipfile
    import zlib

    return (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zlib.error, struct.error, OSError, EOFError, RuntimeError, ValueError, KeyError)


def _clean(name: str) -> str:
    return name.replace("\\", "/").lstrip("/")


def _refused(path: str, size: int, limits: Limits) -> str | None:
    if not path or ".." in path.split("/"):
        return "path_traversal_or_empty"
    return "file_too_large" if size > limits.member_bytes else None


def listed(name: str, file, length: int, limits: Limits) -> Iterator[tuple]:
    """(member, kind, start, packed, size, method, crc, reason) of an archive's
    regular files, whose bytes aren't read; a compressed tar is one stream.
    Of members with one name the first counts."""
    import tarfile
    import zipfile

    kind = archive_kind(name)
    if kind is None:
        yield None, "file", 0, length, length, 0, 0, "text_too_large" if length > limits.text_bytes else None
        return
    if kind not in ("zip", "r:"):
        yield None, "stream", 0, length, length, 0, 0, None
        return
    seen = set()
    try:
        if kind == "zip":
            with zipfile.ZipFile(file) as z:
                for k, info in enumerate(z.infolist()):
                    if k >= limits.zip_members:
                        yield "*", "zip", 0, 0, 0, 0, 0, "max_zip_members_exceeded"
                        return
                    path = _clean(info.filename)
                    if not info.is_dir() and path not in seen:
                        seen.add(path)
                        # what needs more than inflating is found by its place in the directory
                        plain = info.compress_type in (0, 8) and not info.flag_bits & 1
                        yield path, "zip" if plain else "odd", info.header_offset if plain else k, info.compress_size, info.file_size, info.compress_type, info.CRC, _refused(path, info.file_size, limits)
            return
        found = []
        with tarfile.open(fileobj=file, mode=kind) as t:
            for k, info in enumerate(t):
                if k >= limits.tar_members:
                    found.append(("*", "tar", 0, 0, 0, 0, 0, "max_tar_members_exceeded"))
                    break
                if info.issparse():
                    found = [(None, "stream", 0, length, length, 0, 0, None)]
                    break
                path = _clean(info.name)
                if info.isfile() and path not in seen:
                    seen.add(path)
                    found.append((path, "tar", info.offset_data, info.size, info.size, 0, 0, _refused(path, info.size, limits)))
        yield from found
    except _broken() as error:
        yield None, "none", 0, 0, 0, 0, 0, f"archive_open_failed:{type(error).__name__}"


def member_bytes(file, kind: str, start: int, packed: int, size: int, method: int, crc: int, limits: Limits) -> bytes:
    """The bytes of one member, from its range alone."""
    import struct
    import zipfile
    import zlib

    if kind == "odd":
        with zipfile.ZipFile(file) as z:
            return z.read(z.infolist()[start])
    file.seek(start)
    if kind == "zip":
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no local header")
        names, extra = struct.unpack("<HH", head[26:30])
        file.seek(start + 30 + names + extra)
    data = file.read(packed)
    if len(data) < packed:
        raise EOFError("archive ends early")
    if kind == "zip":
        if method == 8:
            inflate = zlib.decompressobj(-15)
            data = inflate.decompress(data, size + 1)
        if len(data) != size or zlib.crc32(data) != crc:
            raise zipfile.BadZipFile("size or checksum differs")
    return data


def streamed(name: str, file, limits: Limits) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(member, bytes, reason) of a tar file read from its start; without a
    member the reason is the archive's, and what came before it stays."""
    import tarfile

    seen = set()
    try:
        with tarfile.open(fileobj=file, mode=archive_kind(name)) as t:
            for k, info in enumerate(t):
                # what has been passed needn't be kept
                t.members = []
                if k >= limits.tar_members:
                    yield "*", None, "max_tar_members_exceeded"
                    return
                path = _clean(info.name)
                if not info.isfile() or path in seen:
                    continue
                seen.add(path)
                reason = _refused(path, info.size, limits)
                yield path, None if reason else t.extractfile(info).read(), reason
    except _broken() as error:
        yield None, None, f"archive_open_failed:{type(error).__name__}"


def _text_of(data: bytes, limits: Limits) -> tuple[str | None, str | None]:
    if len(data) > limits.text_bytes:
        return None, "text_too_large"
    if b"\0" in data[:4096]:
        return None, "binary"
    return data.decode("utf-8", "replace"), None


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _entries(archives: DataFrame, limits: Limits) -> DataFrame:
    """Pass 1: a row for each member of (bundle, name, uri, length, place)."""
    schema = _arrow(ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["uri"]) as file:
                    found = [(row["bundle"], row["name"], row["uri"], row["place"], k, *e) for k, e in enumerate(listed(row["name"], file, row["length"], limits))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)] if found else [pa.array([], t) for t in schema.types], schema=schema)

    return archives.select("bundle", "name", "uri", "length", "place").mapInArrow(run, ENTRY)


def _contents(entries: DataFrame, folder: str, limits: Limits) -> DataFrame:
    """Pass 2: texts of members, and the files that nested archives became."""
    schema = _arrow(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def out(entry: dict, k: int, path: str, data: bytes | None, reason: str | None) -> pa.RecordBatch:
            text = nested = None
            if reason is None and archive_kind(path) and entry["kind"] != "file":
                # named by what it is, so a repeated task writes the same file
                nested = f"{folder}/nested/{hashlib.sha256(path.encode()).hexdigest()[:40]}"
                write_whole(nested, data)
            elif reason is None:
                text, reason = _text_of(data, limits)
            row = (entry["bundle"], path, entry["place"], k, text, reason, nested)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for e in batch.to_pylist():
                path = f"{e['name']}!/{e['member']}" if e["member"] is not None else e["name"]
                if e["reason"] is not None:
                    yield out(e, e["k"], path, None, e["reason"])
                    continue
                with _opened(e["uri"]) as file:
                    if e["kind"] == "stream":
                        for k, (member, data, reason) in enumerate(streamed(e["name"], file, limits)):
                            yield out(e, k, f"{e['name']}!/{member}" if member is not None else e["name"], data, reason)
                        continue
                    try:
                        data, reason = member_bytes(file, e["kind"], e["start"], e["packed"], e["size"], e["method"], e["crc"], limits), None
                    except _broken() as error:
                        data, reason = None, f"member_read_failed:{type(error).__name__}"
                yield out(e, e["k"], path, data, reason)

    return entries.mapInArrow(run, RESULT)


def read_bundles(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(bundle, path, text, skip_reason, priority) of the files of
    archives, the most telling first in ``priority``.  Binary files, files
    over the size, members that can't be read and files beyond the number that
    is read have a reason, no text.  A nested path names the archives it lies
    in; archives are opened level by level, within limits of depth and number.
    A file that is no archive is its own member; an empty archive has no row.

    Files are opened with pyarrow: local, hdfs, s3, gs and abfs paths.
    """
    folder = store_folder(spark, "archives")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    level = files.select(F.col("path").alias("bundle"), F.col("path").alias("name"), F.col("path").alias("uri"), "length", F.lit(1).cast("long").alias("place"))
    opened = level.select("bundle", F.lit(0).cast("long").alias("before"))
    parts, skipped = [], []
    if limits.depth < 1:
        raise ValueError("depth counts the bundles themselves, so it is at least 1")
    for depth in range(limits.depth + 1):
        at = f"{folder}/level={depth}"
        if depth == limits.depth:
            late, go_on = level.withColumn("reason", F.lit("max_nesting_depth")), None
        else:
            many = level.join(opened, "bundle")
            over = F.col("place") + F.col("before") > limits.nested
            late, go_on = many.where(over).withColumn("reason", F.lit("max_nested_archive_expansions")), many.where(~over)
        if depth:
            skipped.append(late.select("bundle", F.col("name").alias("path"), F.lit(None).cast("string").alias("text"), F.col("reason").alias("skip_reason")))
        if go_on is None:
            break
        _entries(go_on, limits).write.parquet(f"{at}/entries")
        entries = spark.read.parquet(f"{at}/entries")
        size = entries.agg(F.count("*").alias("n"), F.sum("packed").alias("b")).first()
        tasks = max(1, min(size["n"], max(spark.sparkContext.defaultParallelism, -(-(size["b"] or 0) // TASK_BYTES))))
        _contents(entries.repartition(tasks, "name", "k"), at, limits).write.parquet(f"{at}/contents")
        contents = spark.read.parquet(f"{at}/contents")
        parts.append(contents.where("nested is null").select("bundle", "path", "text", "skip_reason"))
        nested = contents.where("nested is not null")
        if nested.isEmpty():
            break
        opened = go_on.groupBy("bundle").agg((F.max("before") + F.count("*")).alias("before"))
        lengths = spark.read.format("binaryFile").load(f"{at}/nested").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("_file"), "length")
        order = F.row_number().over(Window.partitionBy("bundle").orderBy("_parent", "k")).cast("long")
        nested = nested.select("bundle", F.col("path").alias("name"), F.col("nested").alias("uri"), F.regexp_extract("nested", r"([^/]*)$", 1).alias("_file"), F.col("place").alias("_parent"), "k")
        level = nested.join(lengths, "_file").withColumn("place", order).select("bundle", "name", "uri", "length", "place")
        level.write.parquet(f"{at}/next")
        level = spark.read.parquet(f"{at}/next")

    rows = parts[0]
    for more in parts[1:] + skipped:
        rows = rows.unionByName(more)
    rows = rows.withColumn("priority", file_priority(F.col("path")))
    # places of narrow rows; the texts stay where they are
    place = Window.partitionBy("bundle").orderBy(F.desc("priority"), "path")
    late = rows.where("text is not null").select("bundle", "path", "priority").withColumn("_place", F.row_number().over(place)).where(F.col("_place") > limits.files)
    late = late.select("bundle", "path", F.lit(True).alias("_late"))
    rows = rows.join(late, ["bundle", "path"], "left")
    return rows.select("bundle", "path", F.when(F.col("_late").isNull(), F.col("text")).alias("text"), F.when(F.col("_late"), "max_files").otherwise(F.col("skip_reason")).alias("skip_reason"), "priority")
