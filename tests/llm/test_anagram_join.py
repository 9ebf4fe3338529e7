import random
import zlib

import pytest

from faultline.llm.anagram_join import anagram_keys, distances, join_names, misspelt, op13_anagram_names, similar_names


def alignment(a, b):
    d = [[i + j if i == 0 or j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def crc(x):
    return zlib.crc32(str(x).encode())


def spelt(name, vendor_id):
    h = crc(vendor_id)
    if h % 2 or len(name) < 2:
        return name
    p = h % (len(name) - 1)
    return name[:p] + name[p + 1] + name[p] + name[p + 2 :]


def brute(clients, vendors, most=2):
    out = {}
    for vendor_id, vendor in {(i, n) for i, n in vendors if n and i is not None}:
        for client_id, client in {(i, n) for i, n in clients if n and i is not None}:
            distance = alignment(spelt(vendor, vendor_id), client)
            if distance <= most:
                n, first, total = out.get((vendor_id, distance), (0, client_id, 0))
                out[vendor_id, distance] = (n + 1, min(first, client_id), total + crc(client_id))
    return {(*key, *value) for key, value in out.items()}


def edited(rng, name, letters):
    name = list(name)
    for _ in range(rng.randrange(4)):
        at, kind = rng.randrange(len(name) + 1), rng.randrange(4)
        if kind == 0:
            name.insert(at, rng.choice(letters))
        elif kind == 1 and name:
            del name[min(at, len(name) - 1)]
        elif kind == 2 and name:
            name[min(at, len(name) - 1)] = rng.choice(letters)
        elif len(name) > 1:
            at = min(at, len(name) - 2)
            name[at : at + 2] = name[at + 1], name[at]
    return "".join(name)


def test_distances_of_all_lengths():
    rng = random.Random(3)
    names = ["".join(rng.choice("aé𝒳b") for _ in range(rng.choice([0, 1, 2, 5, 63, 64, 65, 130]))) for _ in range(300)]
    others = [edited(rng, n, "aé𝒳b") if rng.random() < 0.7 else rng.choice(names) for n in names]
    assert distances(names, others).tolist() == [alignment(a, b) for a, b in zip(names, others)]


def test_keys_are_the_distinct_multisets():
    import itertools

    for name in ("", "a", "aab", "abca", "zzzz"):
        keys, gone = anagram_keys(name, 2)
        expected = {tuple(sorted(c)) for k in range(3) for c in itertools.combinations(name, max(len(name) - k, 0)) if len(name) >= k}
        assert len(keys) == len(set(keys.tolist())) == len(set(gone.tolist())) == len(expected)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_similar_names_against_all_pairs(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abcdeö") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    left = sorted({edited(rng, rng.choice(base), "abcdeö") for _ in range(90)} - {""})
    right = sorted({edited(rng, rng.choice(base), "abcdeö") for _ in range(60)} - {""})
    frames = [spark.createDataFrame(list(enumerate(x)), "id long, name string") for x in (left, right)]
    got = sorted(tuple(r) for r in similar_names(*frames, most).collect())
    assert got == sorted((i, j, d) for i, a in enumerate(left) for j, b in enumerate(right) if (d := alignment(a, b)) <= most)


def test_join_with_odd_rows(spark, tables):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150))
    names = ["Ann Lee", "Ann Lea", "A", "ab", "ba", "Lee Ann", "Zoë Straße", "x" * 70, long]
    clients = [(i, edited(rng, rng.choice(names), "aenL ")) for i in range(120)]
    clients += [(500, None), (501, ""), (None, "Ann Lee"), (3, clients[3][1]), (3, "Ann Lee"), (502, long), (503, long[:-1])]
    vendors = [(i, edited(rng, rng.choice(names), "aenL ")) for i in range(40)]
    vendors += [(90, None), (91, ""), (None, "ab"), (7, vendors[7][1]), (7, "Lee Ann"), (92, "a"), (93, long)]
    extra = lambda rows: [(*r, 1, "k") for r in rows]
    sf = tables(
        clients=(extra(clients), "client_id long, name string, id long, distance string"), vendors=(extra(vendors), "vendor_id long, name string, left_id int, n_clients string")
    )
    got = op13_anagram_names(spark, sf)
    assert got.columns == ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    assert {tuple(r) for r in got.collect()} == brute(clients, vendors)
    read = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/vendors.parquet").where("name <> '' and vendor_id is not null").select("vendor_id", misspelt("name", "vendor_id")).collect()]
    assert sorted(read) == sorted((i, spelt(n, i)) for i, n in vendors if n and i is not None)


def test_empty_tables(spark):
    schema = "client_id long, vendor_id long, name string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, 1, "ab")], schema)
    assert not join_names(none, some).count() and not join_names(some, none).count()


def test_a_hot_name_is_one_name(spark):
    schema = "client_id long, vendor_id long, name string"
    clients = spark.range(30_000).selectExpr("id client_id", "id vendor_id", "if(id % 3 = 0, 'Ann Lee', concat('n', id)) name")
    got = join_names(clients, spark.createDataFrame([(1, 5, "An Lee")], schema)).collect()
    want = "Ann Lee"
    assert [(r.n_clients, r.first_client_id) for r in got if r.distance == alignment(spelt("An Lee", 5), want)] == [(10_000, 0)]
