"""Packing token sequences by the length histogram, shortest pack first.

Documents are cut at multiples of the sequence length; what is left over is
packed.  Only the histogram of lengths (one count for each length up to the
sequence length) reaches the driver, where packing patterns and their counts
are made, so the driver's work doesn't depend on the number of documents.
Patterns join back to pieces by length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import bounded_batches, table, written
from faultline.llm.tokens import document_ids, tokenizer_path

SEQUENCE = 2048
PIECE = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local_rank long"


def cut_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``sequence`` ids.  ``local_rank`` counts the pieces
    of equal length that the same task (``part``) made before."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        schema = pa.schema([("part", pa.int32())] + [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
        for batch, found in document_ids(batches, path):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), found):
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    n = len(piece) // 4
                    row = (part, key, start, n, zlib.crc32(piece), total, seen[n])
                    rows.append(row + (np.frombuffer(piece, np.int32),) if with_ids else row)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (how many sequences, ((length, times), ...)).

    Lengths go longest first.  Each goes into the pack that is shortest, that
    is has most room, while one has room for it; else a new pack opens.
    Equal packs are one pattern with a count, so a length's pieces are placed
    by few steps however many there are.
    """
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    most = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        space = most
        while left and space >= length:
            while left and room[space]:
                count, pattern = room[space].pop()
                take = min(left, count)
                if take < count:
                    room[space].append((count - take, pattern))
                room[space - length].append((take, pattern + ((length, 1),)))
                left -= take
            if not room[space]:
                space -= 1
        if left:
            each = sequence // length
            if full := left // each:
                room[sequence - each * length].append((full, ((length, each),)))
            if rest := left % each:
                room[sequence - rest * length].append((1, ((length, rest),)))
        most = max((s for s, packs in room.items() if packs), default=0)
    return [(count, pattern) for s in sorted(room) for count, pattern in room[s]]


def slots(patterns) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces
    of a length from this rank on fill that place of consecutive sequences."""
    rows, ranks, sequence_id = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rows.append((length, ranks[length], sequence_id, offset))
                ranks[length] += count
                offset += length
        sequence_id += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces of a written table."""
    counts = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row a length
    places = slots(pack_histogram(histogram, sequence))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_before"))
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("rank_before") + F.col("local_rank")).drop("rank_before", "local_rank", "part")
    names = ranked.columns
    shift = 1 << 48
    keys = places[:, 0] * shift + places[:, 1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            row = places[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(length) else places[:0]
            kept = [k for k, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                [names[k] for k in kept] + ["sequence_id", "offset"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset (and ids).

    Nulls: a null text is the end id only; a null doc_id keeps its pieces.
    Repeated rows are packed each.  An empty table gives no rows.  Other
    columns are ignored.  Every id lies in exactly one piece.
    """
    return pack_pieces(written(cut_documents(docs, path, sequence, with_ids), "pieces"), sequence)


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids): padded rows from pieces with ids.  Totals
    that are powers of two stay as they are.  A group is one sequence."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    rows = pieces.groupBy("sequence_id").agg(ids.alias("ids")).withColumn("n_ids", F.size("ids"))
    short = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) != 0
    padding = F.when(short, F.array_repeat(F.lit(pad_id), F.lit(sequence) - F.col("n_ids"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("ids", F.concat("ids", padding))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of SEQUENCE ids: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset.

    Nulls, repeated rows, empty tables and other columns are as
    ``pack_documents`` says.  A very long text is cut; equal lengths go by
    task and place in it.
    """
    return pack_documents(table(spark, sf_dir, "documents"))
