"""Binary token files in document order (Simple-8b shards).

A shard is: magic, four uint64 counts (documents, ids, words, blocks), the
documents' ids (int64), where each document's ids end (uint64), the block
offsets (uint64) and the words (uint64), all little-endian.  Shards sort by
name as documents sort by ``doc_id``.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import simple8b
from faultline.llm.shared import bounded_batches, shared_folder, table, write_file
from faultline.llm.tokens import document_ids, tokenizer_path

MAGIC = b"FLTOK8B1"
NO_ID = -(1 << 63)  # stands for a null doc_id
SHARD_IDS = 1 << 22
MANIFEST = "name string, n_docs long, n_ids long, n_bytes long"


def pack_shard(doc_ids: list[int], ids: list[bytes]) -> bytes:
    ends = np.cumsum([len(x) // 4 for x in ids]).astype("<u8")
    words, offsets = simple8b.encode(np.frombuffer(b"".join(ids), "<u4"))
    head = np.array([len(doc_ids), int(ends[-1]) if len(ends) else 0, len(words), len(offsets)], "<u8")
    return MAGIC + b"".join(x.tobytes() for x in (head, np.array(doc_ids, "<i8"), ends, offsets.astype("<u8"), words.astype("<u8")))


def unpack_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, where each document's ids end, all ids)."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n_ids, n_words, n_offsets = np.frombuffer(payload, "<u8", 4, 8).astype(int).tolist()
    at = 40
    parts = []
    for kind, n in (("<i8", docs), ("<u8", docs), ("<u8", n_offsets), ("<u8", n_words)):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += 8 * n
    ids = simple8b.decode(parts[3], parts[2]).astype("<u4")
    if len(ids) != n_ids:
        raise ValueError("token shard is cut short")
    return parts[0], parts[1], ids


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenize whole texts and write shards in ascending ``doc_id`` order;
    returns the manifest, one row a shard.

    The only shuffle moves the texts once, into ranges of ``doc_id``.  Equal
    ids are ordered by text, so a repeated task writes the same bytes under
    the same name.  A null id sorts first and a null text counts as empty.
    """
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard, held, names, rows = TaskContext.get().partitionId(), 0, 0, [], []
        ids: list[bytes] = []
        doc_ids: list[int] = []

        def flush():
            nonlocal shard, held
            payload = pack_shard(doc_ids, ids)
            name = f"part-{part:06d}-{shard:06d}.s8b"
            write_file(f"{folder}/{name}", payload)
            rows.append((name, len(doc_ids), held, len(payload)))
            shard, held = shard + 1, 0
            ids.clear(), doc_ids.clear()

        for batch, found in document_ids(batches, path):
            for key, x in zip(batch.column(0).to_pylist(), found):
                ids.append(x)
                doc_ids.append(NO_ID if key is None else key)
                held += len(x) // 4
                if held >= shard_ids:
                    flush()
        if doc_ids:
            flush()
        names = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(names, ["name", "n_docs", "n_ids", "n_bytes"])

    return ordered.mapInArrow(run, MANIFEST)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, doc_id, local_start, ids) of every document in the shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, ends, ids = unpack_shard(content.as_buffer().to_pybytes())
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                name = path.rpartition("/")[2]
                for lo in range(0, len(keys), 2048):
                    cut = slice(lo, lo + 2048)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.concatenate((starts[cut], [ends[cut][-1]])) - starts[lo], pa.int32()),
                        pa.array(ids[starts[lo] : int(ends[cut][-1])].astype(np.int64)),
                    )
                    null = keys[cut] == NO_ID
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(null)), pa.array(keys[cut], mask=null), pa.array(starts[cut]), lists],
                        ["name", "doc_id", "local_start", "ids"],
                    )

    return files.select("path", "content").mapInArrow(run, "name string, doc_id long, local_start long, ids array<long>")


def digest(ids_column: str = "ids"):
    """Adds n_tokens and the crc32 of the ids, without moving rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_column))
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["name", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )

    return run


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document as token ids, read the files back and return
    doc_id, start, n_tokens and ids_crc32 of each.

    Nulls: a null text is empty (it has the end id only); a null doc_id sorts
    first and comes back null.  Repeated rows stay, in text order.  An empty
    table gives no rows.  Other columns are ignored.
    """
    folder = shared_folder(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), f"{folder}/shards")
    manifest.write.parquet(f"{folder}/manifest")  # runs the job once
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    # one row for each shard of millions of ids: a running sum in name order
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    rows = read_token_files(spark, f"{folder}/shards").mapInArrow(digest(), "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(shards, "name").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard"))
