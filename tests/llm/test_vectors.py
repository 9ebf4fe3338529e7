import duckdb
import numpy as np

import pytest

from faultline.llm import near_vectors as near
from faultline.llm import posting_search
from faultline.llm.near_vectors import OP10_SQL, calibrate, collide, op10_near_vectors, unit
from faultline.llm.posting_search import CentroidGraph, balanced_centroids, op1_posting_search, search

ROWS = "vec_id long, embedding array<float>, label int"
NAN = float("nan")


def odd():
    return [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [NAN] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [], 1), (9007, [1.0] * 16, None)]


def groups(seed=0, n=300):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    rows = []
    for k in range(n):
        for c in range(1 + 6 * (k % 25 == 0)):
            rows.append((len(rows), (base[k] + rng.normal(size=16) * 0.05 * c).astype(np.float32).tolist(), k % 3))
    return rows + [(len(rows) + i, rows[0][1], 0) for i in range(40)]


def test_near_vectors_equal_sql(spark, tables):
    rows = groups() + odd()
    folder = tables(embeddings=(rows, ROWS))
    got = sorted(map(tuple, op10_near_vectors(spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(OP10_SQL).fetchall())
    assert op10_near_vectors(spark, tables(embeddings=([], ROWS))).count() == 0


def test_collisions_keep_pairs_at_the_bound():
    rng = np.random.default_rng(3)
    a = unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    window, least = calibrate()
    kept = 0
    for lo in range(0, 3000, 500):
        i, j = collide(a[lo : lo + 500], b[lo : lo + 500], window, least)
        kept += int((i == j).sum())
    assert kept >= 2998
    i, j = collide(a[:500], a[500:1000], window, least)
    assert len(i) < 0.02 * 500 * 500
    # dropping pairs early changes nothing
    whole = collide(a[:500], a[500:1000], window, least, dense=near.PROJECTIONS)
    assert set(zip(i, j)) == set(zip(*whole))
    # counts equal those of a plain sweep
    along = near.directions(64, near.PROJECTIONS + 1)[:, 1:]
    apart = np.abs((a[:60] @ along)[:, None] - (a[500:560] @ along)[None]) <= window / 8 + 1e-9
    assert set(zip(*collide(a[:60], a[500:560], window, least))) == set(zip(*np.nonzero(apart.sum(axis=2) >= least)))


def test_parts_beyond_the_most_are_dealt_into_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(near, "MOST_PARTS", 3)
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = [(*r, r[0], "x") for r in groups(2) + odd() + [(None, [1.0] * 16, 1), (5, [3.0] * 4, 1)]]
    folder = tables(embeddings=(rows, ROWS + ", key long, times string"))
    got = sorted(map(tuple, op10_near_vectors(spark, folder).where("vec_id is not null and vec_id <> 5").select("vec_id", "n_links", "component_id", "kept").collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet' where vec_id is not null and not (vec_id = 5 and len(embedding) = 4)")
    want = [r for r in sorted(con.sql(OP10_SQL).fetchall()) if r[0] != 5]
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]


def exact(rows, k=10, step=100):
    """Neighbours of every query by brute force: {query: [(vec_id, score)]}."""
    best = {}
    for i, x, *_ in rows:
        best[i] = min(best.get(i, x), x)
    out = {}
    for d in {len(x) for x in best.values()}:
        ids = np.array([i for i, x in best.items() if len(x) == d])
        x = np.array([best[i] for i in ids], np.float64)
        for q in np.flatnonzero(ids % step == 0):
            far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            far[q] = np.inf
            order = [j for j in np.lexsort((ids, far))[:k] if j != q]
            out[int(ids[q])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def held_to(got, rows):
    """Recall of rows found, whose ranks and scores must be right."""
    best = {i: None for i, *_ in rows}
    for i, x, *_ in rows:
        best[i] = x if best[i] is None else min(best[i], x)
    want, found = exact(rows), {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hit = n = 0
    for q, right in want.items():
        own = sorted(found[q])
        assert [r for r, *_ in own] == list(range(1, len(right) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(abs(np.linalg.norm(np.array(best[v], float) - np.array(best[q], float)) - s) < 1e-9 for _, v, s in own)
        hit, n = hit + len({v for v, _ in right} & {v for _, v, _ in own}), n + len(right)
    return hit / n


def test_search_recall_and_odd_rows(spark, tables):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist(), 0) for k in range(4000)] + [(5000 + k, [0.5] * 16, 0) for k in range(300)]
    # repeated ids with other vectors, and vectors of other lengths
    rows += [(k, rng.normal(size=16).astype(np.float32).tolist(), 0) for k in range(0, 400, 20)] + [(7000 + k, rng.normal(size=5).astype(np.float32).tolist(), 0) for k in range(300)]
    rows += [(8000 + k, rng.normal(size=7).astype(np.float32).tolist(), 0) for k in range(1200)] + [(9400, [1.0], 0)]
    got = op1_posting_search(spark, tables(embeddings=([(*r, 1, 0.5) for r in rows + odd()], ROWS + ", dim int, score double"))).collect()
    assert 9400 not in {r["query_id"] for r in got}  # it has nothing to be compared with
    assert held_to(got, [r for r in rows if r[0] != 9400] + [(9007, [1.0] * 16, None)]) >= 0.9


@pytest.mark.parametrize("most", [2000, 12])
def test_recall_over_many_lists(spark, monkeypatch, most):
    """Some 300 lists of one level, and 12 with lists of their own."""
    monkeypatch.setattr(posting_search, "MOST_LISTS", most)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(500, 64))
    x = (centres[rng.integers(0, 500, 12000)] + rng.normal(size=(12000, 64)) * 0.6).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert held_to(search(df, list_rows=40).collect(), rows) >= 0.9


def test_few_rows_give_few_ranks(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 3.0], 0)], ROWS)
    assert [tuple(r)[1:3] for r in sorted(search(df).collect())] == [(1, 1), (2, 2)]
    assert search(df.limit(0)).count() == 0


def test_graph_walk_finds_near_centroids():
    x = np.random.default_rng(6).normal(size=(4000, 8))
    graph = CentroidGraph(balanced_centroids(x, 200))
    found, far = graph.search(x[:200], 8)
    exact = ((x[:200, None] - graph.centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (found[:, 0] == exact).mean() > 0.95 and (np.diff(far, axis=1) >= 0).all()


def test_repeated_rows_leave_room_for_others(spark):
    """A row repeated more often than there are ranks counts once."""
    rows = [(0, [1.0] * 4, 0)] * 15 + [(k, [1.0] * 4, 0) for k in range(1, 15)] + [(200, [2.0, 1.0, 1.0, 1.0], 0)]
    got = search(spark.createDataFrame(rows, ROWS)).collect()
    at = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 200)}
    assert at == {0: list(range(1, 11)), 200: list(range(10))}


def test_recall_on_unstructured_vectors(spark, monkeypatch):
    """More than 1,000 lists, of which far more than a beam holds have to be
    read: the ratio is found, and the walk goes on until it."""
    counts = []
    probe = posting_search.probe
    monkeypatch.setattr(posting_search, "needed_ratio", lambda *a, f=posting_search.needed_ratio: counts.append(f(*a)) or counts[-1])
    x = np.random.default_rng(8).normal(size=(24_000, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), list_rows=21).collect()
    assert held_to(got, rows) >= 0.9 and counts[0] > posting_search.QUERY_RATIO
    graph = CentroidGraph(balanced_centroids(x[:12_000], 1_100))
    asked, _ = probe(graph, x[::400], np.full(1_100, 22), 10, counts[0])
    gaps = np.sqrt(((x[::400, None] - graph.centroids[None]) ** 2).sum(axis=2))
    within = (gaps <= gaps.min(axis=1, keepdims=True) * counts[0]).sum()
    assert len(asked) >= 0.95 * within and np.bincount(asked).max() > posting_search.BEAM
