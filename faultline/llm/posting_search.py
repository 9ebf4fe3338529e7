"""Nearest neighbours by balanced posting lists.

Centroids of small, balanced clusters are fitted on a bounded sample.  Every
row is indexed under its nearest centroid and, if it lies near a boundary,
under further ones.  Centroids are searched by a best-first walk over an
in-memory neighbour graph; a query reads the lists whose centroid's distance
is within a ratio of the nearest one's, and distances there are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import table, written
from faultline.llm.vectors import matrix, usable

NEIGHBOURS, QUERY_STEP = 10, 100
#: rows that fit the centroids; rows of a list; most lists of one level, which
#: bounds the graph.  A list of more than LONG times LIST_ROWS rows has lists of
#: its own, fitted on SUB_SAMPLE of its rows
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 400, 2_000
LONG, SUB_SAMPLE = 8, 4_000
#: a row is replicated to centroids within this ratio of its nearest, at most
#: so many; a query reads the lists within its ratio.  The beam finds the
#: nearest ones; queries that walk on from it do so together, so many at once
BOUNDARY, REPLICAS = 1.1, 4
QUERY_RATIO, BEAM, WALKERS = 1.12, 128, 256
#: queries that the ratio is found with, and the share of their nearest rows
#: whose lists have to be within it
TESTED, RECALL = 128, 0.96
DEGREE = 16
#: rows that meet queries in one task
PART = 20_000
#: up to so many rows of a vector length are compared without an index
FEW = 1_000


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Halves the largest cluster by two-means at the median until there are
    enough, so clusters stay of like size; then a few rounds of averaging."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    groups = [np.arange(len(sample))]
    while len(groups) < lists:
        groups.sort(key=len)
        if len(groups[-1]) < 2:
            break
        own = groups.pop()
        x = sample[own]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            lean = x @ (a - b)
            half = np.argsort(lean, kind="stable")
            low, high = half[: len(half) // 2], half[len(half) // 2 :]
            b, a = x[low].mean(axis=0), x[high].mean(axis=0)
        groups += [own[low], own[high]]
    return np.array([sample[g].mean(axis=0) for g in groups if len(g)])


class CentroidGraph:
    """Each centroid's nearest ones, a ring through all, and a walk."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        square = (centroids**2).sum(axis=1)
        gaps = square[:, None] + square[None] - 2 * centroids @ centroids.T
        np.fill_diagonal(gaps, np.inf)
        near = np.argsort(gaps, axis=1)[:, : min(DEGREE, max(n - 1, 1))]
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) * 7 + n // 2) % n], axis=1)
        self.links = np.concatenate((near, ring), axis=1)
        self.entry = int(np.argmin(((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1)))

    def search(self, queries: np.ndarray, width: int, ratio: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) found nearest, nearest first; -1 fills.

        Best first: the nearest centroid of the beam that isn't expanded yet
        is next, until the beam has none, or none within the ratio of the
        nearest one found so far while an eighth of the beam is filled.
        """
        n, q = len(self.centroids), len(queries)
        width = min(width, n)
        rows = np.arange(q)
        ids = np.full((q, width), -1)
        far = np.full((q, width), np.inf)
        seen = np.zeros((q, n), bool)
        open_ = np.zeros((q, width), bool)
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        far[:, 0] = ((queries - self.centroids[self.entry]) ** 2).sum(axis=1)
        while len(rows):
            # the queries that go on
            ahead = np.where(open_[rows], far[rows], np.inf)
            best = ahead.argmin(axis=1)
            near = ahead[np.arange(len(rows)), best]
            on = np.isfinite(near) & ((near <= far[rows, 0] * ratio**2) | ~np.isfinite(far[rows, width // 8]))
            rows, best = rows[on], best[on]
            if not len(rows):
                break
            open_[rows, best] = False
            reach = self.links[ids[rows, best]]
            fresh = ~seen[rows[:, None], reach]
            seen[rows[:, None], reach] = True
            gap = ((self.centroids[reach] - queries[rows, None]) ** 2).sum(axis=2)
            gap[~fresh] = np.inf
            # a centroid may be linked twice: keep one of them
            order = np.argsort(reach, axis=1, kind="stable")
            sorted_reach = np.take_along_axis(reach, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_reach[:, 1:] == sorted_reach[:, :-1], 1)
            gap[twice] = np.inf
            all_far = np.concatenate((far[rows], gap), axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            far[rows] = np.take_along_axis(all_far, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], reach), axis=1), keep, 1)
            open_[rows] = np.take_along_axis(np.concatenate((open_[rows], np.isfinite(gap)), axis=1), keep, 1) & np.isfinite(far[rows])
        ids[~np.isfinite(far)] = -1
        return ids, np.sqrt(far)

    def within(self, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first; -1 fills: all that the walk
        reaches within ``ratio`` of the nearest one, however many.

        A beam finds the nearest; where it is full of centroids within the
        ratio, the walk goes on from all of them until it meets no more.
        """
        ids, far = self.search(queries, BEAM, ratio)
        full = np.flatnonzero((ids[:, -1] >= 0) & (far[:, -1] <= far[:, 0] * ratio + 1e-12))
        if ids.shape[1] == len(self.centroids) or not len(full):
            return ids, far
        n = len(self.centroids)
        out_ids, out_far = np.full((len(queries), n), -1), np.full((len(queries), n), np.inf)
        out_ids[:, : ids.shape[1]], out_far[:, : ids.shape[1]] = ids, far
        for lo in range(0, len(full), WALKERS):
            own = full[lo : lo + WALKERS]
            gap = np.full((len(own), n), np.inf)
            np.put_along_axis(gap, ids[own], far[own], 1)
            done = np.zeros(gap.shape, bool)
            while True:
                ahead = ~done & (gap <= gap.min(axis=1, keepdims=True) * ratio + 1e-12)
                row, at = np.nonzero(ahead)
                if not len(row):
                    break
                done |= ahead
                fresh = np.zeros(gap.shape, bool)
                fresh[np.repeat(row, self.links.shape[1]), self.links[at].ravel()] = True
                row, at = np.nonzero(fresh & np.isinf(gap))
                for k in range(0, len(row), 1 << 15):
                    r, c = row[k : k + (1 << 15)], at[k : k + (1 << 15)]
                    gap[r, c] = np.sqrt(((queries[own[r]] - self.centroids[c]) ** 2).sum(axis=1))
            order = np.argsort(gap, axis=1, kind="stable")
            out_far[own] = np.take_along_axis(gap, order, 1)
            out_ids[own] = np.where(np.isfinite(out_far[own]), order, -1)
        return out_ids, out_far


def _chunks(batches, size: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def assign(graph: CentroidGraph, rows: np.ndarray, replicas: int = REPLICAS, ratio: float = BOUNDARY) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists each row goes to."""
    found, far = graph.search(rows, max(4 * replicas, 16))
    take = (found >= 0) & (far <= far[:, :1] * ratio + 1e-12)
    take[:, replicas:] = False
    # a further list is worth a replica only if its centroid isn't nearer to
    # a list that the row is in already
    for k in range(1, min(replicas, found.shape[1])):
        c = graph.centroids[found[:, k]]
        for j in range(k):
            gap = np.sqrt(((c - graph.centroids[found[:, j]]) ** 2).sum(axis=1))
            take[:, k] &= ~(take[:, j] & (gap < far[:, k] * 0.5))
    row, col = np.nonzero(take)
    return row, found[row, col]


def probe(graph: CentroidGraph, rows: np.ndarray, sizes: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists each query reads: those within the ratio, and
    the nearest that hold enough rows."""
    found, far = graph.within(rows, ratio)
    held = np.cumsum(np.where(found >= 0, sizes[found], 0), axis=1)
    take = (found >= 0) & ((far <= far[:, :1] * ratio + 1e-12) | (held - sizes[found] < 20 * (k + 1)))
    row, col = np.nonzero(take)
    return row, found[row, col]


def _listed(shared, choose, size: int):
    """Rows with each list that ``choose`` gives them."""

    def run(batches):
        graph = CentroidGraph(shared.value)
        for batch in _chunks(batches, size):
            row, lists = choose(graph, matrix(batch.column(batch.schema.get_field_index("embedding"))))
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lists.astype(np.int32))], [*picked.schema.names, "list"])

    return run


def _sub_centroids(dim: int, list_rows: int):
    """Centroids of a long list from rows of it: one row a list."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        sample = matrix(got["embedding"])
        lists = max(1, min(int(got["size"][0].as_py()) // list_rows, len(sample) // 10))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([balanced_centroids(sample, lists).tobytes()], pa.binary())], ["list", "centroids"])

    return run


def _sub_listed(choose, dim: int, schema: list[str]):
    """Rows of a long list with each of its own lists that they go to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(schema).slice(0, 0).append_column("sub", pa.array([], pa.int32()))
        graph = CentroidGraph(np.frombuffer(right["centroids"][0].as_py(), np.float64).reshape(-1, dim))
        out = []
        for lo in range(0, left.num_rows, 512):
            part = left.select(schema).slice(lo, 512)
            row, lists = choose(graph, matrix(part["embedding"]))
            out.append(part.take(pa.array(row)).append_column("sub", pa.array(lists.astype(np.int32))))
        return pa.concat_tables(out)

    return run


def _compare(queries: pa.Table, rows: pa.Table, k: int):
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not rows.num_rows:
        return
    ids, x = rows["vec_id"].to_numpy(), matrix(rows["embedding"])
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    squares = (x**2).sum(axis=1)
    q_ids, q = queries["query_id"].to_numpy(), matrix(queries["embedding"])
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = squares[None] - 2 * part @ x.T
        slack = 1e-9 * (squares.max() + (part**2).sum(axis=1).max() + 1e-300)
        out = ([], [], [])
        for i in range(len(part)):
            own = rough[i].copy()
            own[ids == q_ids[lo + i]] = np.inf
            if k < len(own):
                edge = np.partition(own, k - 1)[k - 1]
                near = np.flatnonzero((own <= edge + slack) & np.isfinite(own))
            else:
                near = np.flatnonzero(np.isfinite(own))
            score = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], score))[:k]
            out[0].append(np.full(len(best), q_ids[lo + i]))
            out[1].append(ids[near][best])
            out[2].append(score[best])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)


def search(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, ratio: float | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row
    whose vec_id is divisible by ``step``, among all other rows.

    Score is the Euclidean distance in double precision; ties go to smaller
    ids.  Vectors that are null, empty or zero or hold null or non-finite
    components, and rows without an id, take no part.  Rows that repeat an id
    count once, with the smallest of their vectors.  Vectors of different
    lengths are compared with their like.  Fewer candidates give fewer ranks,
    an empty table none.  Other columns are ignored.  Without a ``ratio`` that
    is taken with which TESTED queries find RECALL of their nearest rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    # an id counts once
    unique = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    dims = {r["dim"]: r["count"] for r in unique.groupBy("dim").count().collect()}  # a row a length
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    pair = "query_id long, vec_id long, score double"
    few = [d for d, n in dims.items() if n <= FEW]
    found = []
    if few:  # each length is one group of at most FEW rows
        own = unique.where(F.col("dim").isin(few))
        asked = own.where(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id")
        found.append(asked.groupBy("dim").cogroup(own.groupBy("dim")).applyInArrow(_grouped(k), pair))
    for dim, n in dims.items():
        if n > FEW:
            found.append(_search_indexed(unique.where(F.col("dim") == dim).drop("dim"), n, dim, k, step, ratio, list_rows))
    found = reduce(DataFrame.unionByName, found)
    ranks = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_indexed(unique: DataFrame, total: int, dim: int, k: int, step: int, ratio: float | None, list_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of candidates from the lists a query reads."""
    spark = unique.sparkSession
    # of equal vectors only those that can be among the k nearest are indexed:
    # the smallest ids and, for a query of that vector, itself
    copies = Window.partitionBy("copy").orderBy("vec_id")
    index = unique.withColumn("copy", F.xxhash64("embedding")).withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).drop("copy", "place")
    share = max(total // SAMPLE, 1)
    sample = unique.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("embedding").limit(2 * SAMPLE).toArrow()
    fitted = matrix(sample["embedding"])
    lists = int(min(max(total // list_rows, 1), MOST_LISTS, max(len(fitted) // 10, 1)))
    shared = spark.sparkContext.broadcast(balanced_centroids(fitted, lists))  # at most MOST_LISTS rows
    held = written(index.mapInArrow(_listed(shared, assign, 1024), "vec_id long, embedding array<double>, list int"), "lists")
    sizes = np.zeros(len(shared.value), np.int64)
    for r in held.groupBy("list").count().collect():  # one row a centroid
        sizes[r["list"]] = r["count"]
    queries = unique.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    if ratio is None:
        ratio = needed_ratio(shared.value, queries, held, k)
    probes = queries.mapInArrow(_listed(shared, lambda graph, x: probe(graph, x, sizes, k, ratio), 256), "query_id long, embedding array<double>, list int")
    size_of = F.greatest(F.element_at(F.lit([int(s) for s in sizes]), F.col("list") + 1), F.lit(1))
    held, probes = (x.withColumn("sub", F.lit(0)) for x in (held, probes))
    if (sizes > LONG * list_rows).any():
        held, probes = _second_level(held, probes, size_of, dim, k, ratio, list_rows)
    # a long list has SUB_SAMPLE / 10 lists at most; larger ones are dealt
    # over several tasks, to which their queries go
    slices = F.ceil(size_of / (PART * (SUB_SAMPLE // 10))).cast("int")
    held = held.withColumn("slice", F.pmod(F.xxhash64("vec_id"), slices).cast("int"))
    probes = probes.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    cell = ["list", "sub", "slice"]
    return probes.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_grouped(k), "query_id long, vec_id long, score double")


def needed_ratio(centroids: np.ndarray, queries: DataFrame, held: DataFrame, k: int) -> float:
    """The ratio within which TESTED queries have the lists of RECALL of their
    k nearest rows, found by comparing these queries with every indexed row."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TESTED).collect()
    if not asked:
        return QUERY_RATIO
    ids, x = np.array([r["query_id"] for r in asked]), np.array([r["embedding"] for r in asked])
    kept = (k + 1) * REPLICAS

    def nearest(batches):
        for batch in _chunks(batches, 4096):
            rows = matrix(batch.column(batch.schema.get_field_index("embedding")))
            gap = (x**2).sum(axis=1)[:, None] - 2 * x @ rows.T + (rows**2).sum(axis=1)[None]
            best = np.argpartition(gap, kept - 1, axis=1)[:, :kept] if gap.shape[1] > kept else np.tile(np.arange(gap.shape[1]), (len(x), 1))
            q = np.repeat(np.arange(len(x)), best.shape[1])
            at = pa.array(best.ravel())
            columns = [pa.array(q), batch.column("vec_id").take(at), batch.column("list").take(at), pa.array(gap[q, best.ravel()])]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "vec_id", "list", "gap"])

    found = held.mapInArrow(nearest, "q long, vec_id long, list int, gap double").groupBy("q", "vec_id").agg(F.min("gap").alias("gap"), F.collect_set("list").alias("lists"))
    first = Window.partitionBy("q").orderBy("gap", "vec_id")
    near = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).collect()  # TESTED times k + 1
    far = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)[None], 0))
    needed = [far[r["q"], r["lists"]].min() / max(far[r["q"]].min(), 1e-12) for r in near if r["vec_id"] != ids[r["q"]]]
    return float(np.quantile(needed, RECALL)) + 1e-6 if needed else QUERY_RATIO


def _second_level(held: DataFrame, probes: DataFrame, size_of: Column, dim: int, k: int, ratio: float, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Lists of the long lists: rows go to them and queries read them as those
    of the first level.  Centroids stay a table; a long list's rows and
    queries meet them in parts of bounded size."""
    long = size_of > LONG * list_rows
    some = held.where(long & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.ceil(size_of / SUB_SAMPLE)) == 0)).withColumn("size", size_of.cast("long"))
    fitted = written(some.groupBy("list").applyInArrow(_sub_centroids(dim, list_rows), "list int, centroids binary"), "sub-centroids")
    out = []
    choices = (assign, lambda graph, x: probe(graph, x, np.full(len(graph.centroids), list_rows), k, ratio))
    for rows, name, choose in ((held, "vec_id", choices[0]), (probes, "query_id", choices[1])):
        tasks = F.ceil(size_of / PART).cast("int")
        far = rows.where(long).withColumn("slice", F.pmod(F.xxhash64(name), tasks).cast("int"))
        near = fitted.withColumn("slice", F.explode(F.sequence(F.lit(0), tasks - 1)))
        columns = [name, "embedding", "list"]
        moved = far.groupBy("list", "slice").cogroup(near.groupBy("list", "slice")).applyInArrow(_sub_listed(choose, dim, columns), f"{name} long, embedding array<double>, list int, sub int")
        out.append(rows.where(~long).unionByName(written(moved, "sub-lists")))
    return out[0], out[1]


def _grouped(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(list(_compare(left, right, k)), schema)

    return run


def op1_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the NEIGHBOURS nearest rows found
    in ``embeddings`` for every row whose vec_id is divisible by QUERY_STEP.

    Nulls, odd vectors, repeated ids, ties, other lengths and other columns
    are as ``search`` says; no rows give no rows.
    """
    return search(table(spark, sf_dir, "embeddings"))
