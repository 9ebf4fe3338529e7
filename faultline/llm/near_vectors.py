"""Near-duplicate vectors by collision counting over sorted projections.

Unit vectors of one label are projected onto many random directions.  Around
each vector every sorted projection has a window, which is one run of it; a
pair collides where one lies in the other's run, and pairs with enough
collisions are verified exactly.  The window and the count are calibrated: the
difference of two projections is normal with a deviation of the vectors'
distance, so collisions of a pair at the similarity bound are binomial and the
count is the largest that keeps the asked recall.  A pair that has missed more
runs than that allows is dropped before the rest of them are looked at.

Vectors of a label are dealt by one more projection into parts of like size,
and large parts by hash into blocks.  As that direction has length 1, a pair's
projections differ by no more than its distance, so pairs of parts farther
apart than that are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.shared import connected_components, table, written
from faultline.llm.vectors import matrix, usable

COSINE = 0.93
PROJECTIONS, RECALL, SEED = 40, 0.99999, 11
#: vectors of a block; most parts of a label, beyond which parts are dealt
#: into blocks by hash
BLOCK, MOST_PARTS = 1024, 1000
#: projections of which all pairs of a block are counted; rows at a time
DENSE, ROWS = 20, 256


def calibrate(cosine: float = COSINE, projections: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """(half window in units of 1 / sqrt(dimension), least collisions)."""
    distance = math.sqrt(2 * (1 - cosine))
    hit = 0.97
    # the half window that catches a pair at the bound with probability hit
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < hit else (lo, mid)
    missed, least = 0.0, 0
    for k in range(projections + 1):
        missed += math.comb(projections, k) * hit**k * (1 - hit) ** (projections - k)
        if missed > 1 - recall:
            least = k
            break
    return hi * distance, least


def directions(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """Unit directions, the same in every process."""
    found = np.random.default_rng([seed, dim]).standard_normal((dim, count))
    return found / np.linalg.norm(found, axis=0)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def collide(a: np.ndarray, b: np.ndarray, window: float, least: int, seed: int = SEED, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of a and b with enough collisions.

    A query's run of a sorted projection is a range of places, so a pair
    collides if b's place lies in a's range.  Places are counted over the
    first ``dense`` projections for all pairs of ROWS rows at a time, then
    over the others for the pairs that can still reach the count.
    """
    # one direction is left to the blocks
    along = directions(a.shape[1], PROJECTIONS + 1, seed)[:, 1:]
    reach = window / math.sqrt(a.shape[1]) + 1e-9
    x, y = a @ along, b @ along
    order = np.argsort(y, axis=0, kind="stable")
    kind = np.uint16 if len(b) < 1 << 16 else np.uint32
    place = np.empty((PROJECTIONS, len(b)), kind)
    begin, width = (np.empty((PROJECTIONS, len(a)), kind) for _ in range(2))
    for k in range(PROJECTIONS):
        line = y[order[:, k], k]
        place[k, order[:, k]] = np.arange(len(b))
        begin[k] = np.searchsorted(line, x[:, k] - reach, "left")
        width[k] = np.searchsorted(line, x[:, k] + reach, "right") - begin[k]
    dense = min(dense, PROJECTIONS)
    first, second = [], []
    for lo in range(0, len(a), ROWS):
        at, far = begin[:, lo : lo + ROWS, None], width[:, lo : lo + ROWS, None]
        counts = np.zeros((at.shape[1], len(b)), np.uint8)
        for k in range(dense):
            counts += (place[k] - at[k]) < far[k]  # wraps around below the range
        i, j = np.nonzero(counts >= max(least - (PROJECTIONS - dense), 0))
        more = counts[i, j]
        for k in range(dense, PROJECTIONS):
            more = more + ((place[k, j] - begin[k, lo + i]) < width[k, lo + i])
        i, j = i[more >= least], j[more >= least]
        first.append(lo + i)
        second.append(j)
    return np.concatenate(first), np.concatenate(second)


def _block_links(cosine: float):
    window, least = calibrate(cosine)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).sort_by("key")
        first, second = key[2].as_py(), key[3].as_py()
        part = got["block"].to_numpy()
        keys, times = got["key"].to_numpy(), got["times"].to_numpy()
        rows = unit(matrix(got["embedding"]))
        here, there = (np.flatnonzero(part == p) for p in (first, second))
        links = np.zeros(len(keys), np.int64)
        parent = np.arange(len(keys))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        edges = []
        i, j = collide(rows[here], rows[there], window, least) if len(here) and len(there) else (np.zeros(0, int), np.zeros(0, int))
        i, j = here[i], there[j]
        if first == second:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            near = np.einsum("ij,ij->i", rows[x], rows[y]) >= cosine
            x, y = x[near], y[near]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            for s, t in zip(x.tolist(), y.tolist()):
                s, t = root(s), root(t)
                if s != t:
                    parent[max(s, t)] = min(s, t)
                    edges.append((keys[s], keys[t]))
        some = np.flatnonzero(links)
        # a row for each linked vector, and a row for each edge of a forest
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((keys[some], np.array([e[0] for e in edges], np.int64)))), pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64)))), pa.array([None] * len(some) + [int(e[1]) for e in edges], pa.int64())],
            ["key", "n", "other"],
        )

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null and the cosine of their
    vectors, in double precision, is at least ``cosine``.  Nulls: a vector
    that is null, empty or zero or holds null or non-finite components, and a
    row without label, links with nothing; a null vec_id names no component
    and isn't kept.  Every row counts as a vector, also when it repeats.
    Vectors of different lengths don't link.  Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & usable("embedding"), F.xxhash64("label", "embedding")))
    # equal vectors are one class: groups of copies meet no pairs
    classes = rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("times"), F.min("vec_id").alias("vec_id")
    )

    def project(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            dims = pc.list_value_length(column).to_numpy()
            along = np.empty(batch.num_rows)
            for dim in np.unique(dims).tolist():
                if dim not in known:
                    known[dim] = directions(dim, PROJECTIONS + 1)[:, 0]
                own = np.flatnonzero(dims == dim)
                along[own] = unit(matrix(column.take(pa.array(own)))) @ known[dim]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], [*batch.schema.names, "along"])

    label_type = classes.schema["label"].dataType.simpleString()
    classes = classes.withColumn("dim", F.size("embedding"))
    classes = written(
        classes.mapInArrow(project, f"key long, label {label_type}, embedding array<double>, times long, vec_id long, dim int, along double"), "vector-classes"
    )
    # cuts of a label's projections into parts: one row a label
    steps = [k / MOST_PARTS for k in range(1, MOST_PARTS)]
    cuts = classes.groupBy("label", "dim").agg(F.count("*").alias("size"), F.percentile_approx("along", steps, 20000).alias("points"))
    # every k-th of the points bounds a part, as its size asks
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("size") / BLOCK)).cast("int")
    inner = F.when(parts > 1, F.sequence(F.lit(1), parts - 1)).otherwise(F.array().cast("array<int>"))
    cuts = cuts.select(
        "label", "dim", F.transform(inner, lambda i: F.col("points")[F.floor(i * MOST_PARTS / parts).cast("int") - 1]).alias("cuts"),
        F.ceil(F.col("size") / (MOST_PARTS * BLOCK)).cast("int").alias("blocks"),
    )
    cuts = written(cuts, "cuts")
    placed = classes.join(cuts, ["label", "dim"]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("along"))))
    reach = math.sqrt(2 * (1 - cosine)) + 1e-9
    # parts at or above this row's whose lower bound is within reach, and
    # parts below it whose upper bound is; of each all blocks
    others = F.filter(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda p: F.when(p > F.col("part"), F.col("cuts")[p - 1] <= F.col("along") + reach).when(p < F.col("part"), F.col("cuts")[p] >= F.col("along") - reach).otherwise(True),
    )
    block = F.col("part").cast("long") * F.col("blocks") + F.pmod(F.xxhash64("key"), F.col("blocks"))
    others = F.flatten(F.transform(others, lambda p: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda s: p.cast("long") * F.col("blocks") + s)))
    spread = placed.withColumn("block", block).withColumn("other", F.explode(others))
    spread = spread.select("label", "dim", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "times", "embedding")
    found = written(spread.groupBy("label", "dim", "p", "q").applyInArrow(_block_links(cosine), "key long, n long, other long"), "vector-links")
    counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("linked"))
    labels = connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "times", "vec_id").join(labels, classes["key"] == labels["node"], "left").select("key", "times", "vec_id", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(lowest, "component").join(counts, "key", "left").select("key", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings``:
    links of equal labels at a cosine of COSINE or more.

    Nulls, odd vectors, repeated rows, ties and other columns are as
    ``near_vectors`` says; no rows give no rows.
    """
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN links l ON l.a = r.seen)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN reach r ON r.node = e.vec_id
"""
