"""Helpers every training-data operator uses: the shared folder, written
tables, Arrow access to whole texts and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and every executor see.

    The cluster names its root in ``spark.checkpoint.dir``; only where that is
    unset (tests, a laptop) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: rows of an Arrow batch of whole texts
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH_ROWS from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives a worker's free memory back before it waits for its next task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of ``written`` that nothing will read again.  Frames
    derived from them mustn't be run afterwards."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            remove_folder(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs whose frames are
    gone, which it else does when the driver happens to collect its garbage.
    What Python frees is free in the JVM a moment later, hence three times."""
    import gc
    import time

    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def release_plans(spark: SparkSession) -> None:
    """Frees the plans and broadcasts of frames that are gone.  A job of many
    plans else lets the driver's heap grow to its limit, though little of it is
    in use: a full collection gives what is free back to the system."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, payload: bytes) -> None:
    """Write under another name first, then rename: a repeated task leaves one
    whole file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(payload)
    store.move(part, path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Cut documents into runs of about ``limit`` bytes; a longer document is
    a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Alternates large-star and small-star until nothing changes; each round
    joins the edges with the least neighbour of each node, and is written to
    the shared folder in place of the one before.  The number of rounds grows
    with the logarithm of the longest path; when ``max_rounds`` don't settle
    it, that is an error.  Empty input gives an empty result.
    """
    current = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct(), "cc")
    if not current.take(1):
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("b", "a")) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = both.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        return (
            joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.where("a <> low").select("a", F.col("low").alias("b")))
            .distinct()
        )

    seen = None
    for _ in range(max_rounds):
        before, current = current, written(star(star(current, True), False), "cc")
        discard(before)
        # a fixpoint leaves every edge as (node, root); a checksum shows it
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            labels = written(current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "components")
            discard(current)
            return labels
        seen = now
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
