import random

from faultline.operators.drilldown import drill_down

EDGES = "source string, target string, type string, probability double"


def brute(edges, starts):
    """All simple paths, one by one."""
    steps = {}
    for s, t, _, p in edges:
        if s is not None and t is not None and p is not None and p == p and p > 0:
            steps.setdefault(s, {})[t] = max(steps.get(s, {}).get(t, 0.0), min(p, 1.0))
    best = {}

    def walk(start, path, p):
        key, rank = (start, path[-1]), (-p, len(path) - 1, " > ".join(path))
        best[key] = min(best.get(key, rank), rank)
        for t, q in steps.get(path[-1], {}).items():
            if t not in path:
                walk(start, [*path, t], p * q)

    for s in {s for s in starts if s is not None}:
        walk(s, [s], 1.0)
    return {(*k, -minus, hops, path) for k, (minus, hops, path) in best.items()}


def got(spark, edges, starts, **kw):
    rows = drill_down(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in starts], "id string"), **kw).collect()
    return {(r["id"], r["reached"], r["probability"], r["hops"], r["path"]) for r in rows}


def test_random_graphs_with_cycles(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", "caused_by", r.choice([0.25, 0.5, 1.0])) for _ in range(18)]
        starts = ["n0", "n1", "n1", "lone", None]
        assert got(spark, edges, starts) == brute(edges, starts)


def test_long_chain(spark):
    chain = [(f"c{k}", f"c{k + 1}", "t", 1.0) for k in range(12)]
    found = got(spark, chain, ["c0"])
    assert len(found) == 13 and max(f[3] for f in found) == 12


def test_odd_edges_and_empty_tables(spark):
    edges = [("a", "b", "t", 7.0), ("b", None, "t", 1.0), (None, "c", "t", 1.0), ("b", "c", "t", None), ("b", "d", "t", 0.0), ("b", "e", "t", float("nan")), ("b", "a", "t", 1.0), ("b", "f", "u", 0.5)]
    assert got(spark, edges, ["a"], kind="t") == {("a", "a", 1.0, 0, "a"), ("a", "b", 1.0, 1, "a > b")}
    assert got(spark, edges, ["a"]) >= {("a", "f", 0.5, 2, "a > b > f")}
    assert got(spark, [], ["a"]) == {("a", "a", 1.0, 0, "a")} and got(spark, edges, []) == set()
