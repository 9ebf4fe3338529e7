"""Edit-distance join of names through anagram keys.

A name's letters, order aside, are a multiset.  Exchanging letters leaves it
alone, a deletion or insertion moves one letter, a substitution one letter on
either side; so names within distance k have a multiset in common after at
most k letters are deleted from each.  Every name emits the hashes of its
multiset with up to k letters deleted, equal keys meet in an equi-join, and the
order of letters is verified with a bit-parallel distance (optimal string
alignment).  A key carries the letters deleted for it: a pair is taken where
what the two sides deleted is disjoint, which holds for the intersection of the
two multisets alone, so each pair is verified once.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.shared import discard, table, written
from faultline.llm.words import mix

#: edits that a pair may differ in, so also letters deleted for a key
MOST_EDITS = 2
#: names that one task emits keys of, pairs that are verified at once
NAMES_A_TASK, PAIRS_AT_ONCE = 20_000, 8_192
#: bits of a code point in the packed deleted letters
_BITS, _LETTERS = 21, 3
_NO_LETTER = {"left": (1 << _BITS) - 1, "right": (1 << _BITS) - 2}  # above all code points
#: keys of one Arrow batch
_KEYS = 50_000


def code_points(name: str) -> np.ndarray:
    return np.frombuffer(name.encode("utf-32-le"), np.uint32)


@lru_cache(512)
def _choices(letters: int, deleted: int) -> np.ndarray:
    """All multisets of ``deleted`` of so many letters, a row each, sorted."""
    rows = list(itertools.combinations_with_replacement(range(letters), deleted))
    return np.array(rows, np.int32).reshape(len(rows), deleted)


def anagram_keys(name: str, most: int, side: str = "left") -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct multiset left after up to ``most`` letters are
    deleted, the deleted letters packed into a long)."""
    letters, counts = np.unique(code_points(name), return_counts=True)
    hashes = mix(letters.astype(np.uint64) + np.uint64(0x5DEECE66D))
    whole = (hashes * counts.astype(np.uint64)).sum(dtype=np.uint64)
    keys, gone = [], []
    for deleted in range(min(most, int(counts.sum())) + 1):
        # many letters at a time would fill the cache with choices of one name
        chosen = _choices(len(letters), deleted) if len(letters) <= 64 else _choices.__wrapped__(len(letters), deleted)
        for apart in range(1, deleted):  # a letter goes no more often than it is there
            again = chosen[:, apart:] == chosen[:, :-apart]
            chosen = chosen[~(again & (counts[chosen[:, apart:]] <= apart)).any(axis=1)]
        keys.append(whole - hashes[chosen].sum(axis=1, dtype=np.uint64))
        packed = np.zeros(len(chosen), np.int64)
        for place in range(_LETTERS):
            letter = letters[chosen[:, place]].astype(np.int64) if place < deleted else np.int64(_NO_LETTER[side])
            packed |= letter << np.int64(place * _BITS)
        gone.append(packed)
    return np.concatenate(keys).view(np.int64), np.concatenate(gone)


def _disjoint(most: int) -> Column:
    """No letter was deleted on both sides; the marks of no letter differ."""

    def letter(column: str, place: int) -> Column:
        return F.shiftright(F.col(column), place * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))

    out = F.lit(True)
    for i, j in itertools.product(range(most), repeat=2):
        out = out & (letter("left_gone", i) != letter("right_gone", j))
    return out


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Optimal string alignment distance of each pair, bit-parallel: the rows
    of many pairs advance together in 64-bit words; a name of more than 64 code
    points has a long integer of its own."""
    out = np.zeros(len(left), np.int64)
    sizes = np.fromiter(map(len, left), np.int64, len(left))
    short = np.flatnonzero((sizes <= 64) & (sizes > 0))
    for k in np.flatnonzero((sizes > 64) | (sizes == 0)):
        out[k] = _long_distance(left[k], right[k])
    for lo in range(0, len(short), PAIRS_AT_ONCE):
        own = short[lo : lo + PAIRS_AT_ONCE]
        out[own] = _short_distances([left[k] for k in own], [right[k] for k in own])
    return out


def _padded(names: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    out = np.full((len(names), int(lengths.max())), filler, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = code_points("".join(names))
    return out, lengths


def _short_distances(left: list[str], right: list[str]) -> np.ndarray:
    a, a_len = _padded(left, 0xFFFFFFFF)
    b, b_len = _padded(right, 0xFFFFFFFE) if any(right) else (np.zeros((len(right), 0), np.uint32), np.zeros(len(right), np.int64))
    one = np.uint64(1)
    bit = one << np.arange(a.shape[1], dtype=np.uint64)
    last = one << (a_len - 1).astype(np.uint64)
    score = a_len.copy()
    plus = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    minus, diagonal, before = (np.zeros(len(a), np.uint64) for _ in range(3))
    for j in range(b.shape[1]):
        match = ((a == b[:, j : j + 1]) * bit).sum(axis=1, dtype=np.uint64)
        exchanged = ((~diagonal & match) << one) & before
        diagonal = (((match & plus) + plus) ^ plus) | match | minus | exchanged
        up, down = minus | ~(diagonal | plus), diagonal & plus
        inside = j < b_len
        score += inside & ((up & last) != 0)
        score -= inside & ((down & last) != 0)
        up, down = (up << one) | one, down << one
        plus, minus, before = down | ~(diagonal | up), up & diagonal, match
    return score


def _long_distance(a: str, b: str) -> int:
    if not a or not b:
        return len(a) + len(b)
    every, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    places: dict[str, int] = {}
    for k, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << k
    plus, minus, diagonal, before = every, 0, 0, 0
    for letter in b:
        match = places.get(letter, 0)
        exchanged = ((~diagonal & match) << 1) & before
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus | exchanged) & every
        up, down = (minus | ~(diagonal | plus)) & every, diagonal & plus
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        plus, minus, before = (down | ~(diagonal | up)) & every, up & diagonal, match
    return score


def _keys(names: DataFrame, most: int, side: str) -> DataFrame:
    """(key, side_gone, side_id) of every name of (id, name)."""

    def emit(batches):
        for batch in batches:
            ids, names = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            held, size = [], 0
            for at, name in zip(ids, names):
                keys, gone = anagram_keys(name, most, side)
                held.append((keys, gone, np.full(len(keys), at, np.int64)))
                size += len(keys)
                if size >= _KEYS:
                    yield from cut(held)
                    held, size = [], 0
            if held:
                yield from cut(held)

    def cut(held):
        columns = [np.concatenate(x) for x in zip(*held)]
        for lo in range(0, len(columns[0]), 2 * _KEYS):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 2 * _KEYS]) for c in columns], names=["key", f"{side}_gone", f"{side}_id"])

    parts = max(1, -(-names.count() // NAMES_A_TASK))
    return names.select("id", "name").repartition(parts).mapInArrow(emit, f"key long, {side}_gone long, {side}_id long")


def _verify(batches, most: int):
    for batch in batches:
        found = distances(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        near = np.flatnonzero(found <= most)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(near)), batch.column(1).take(pa.array(near)), pa.array(found[near].astype(np.int32))], names=["left_id", "right_id", "distance"]
        )


def similar_names(left: DataFrame, right: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """(left_id, right_id, distance) of all pairs of names at most
    ``most_edits`` (0 to 3) insertions, deletions, substitutions or exchanges
    of neighbours apart, each pair once.

    Both sides are (id long, name string) with ids and names that don't
    repeat; further columns are ignored.  They are read several times, so give
    stored tables.  Null and empty names take no part; names of any length are
    compared whole; an empty side gives no pair.
    """
    if not 0 <= most_edits <= _LETTERS:
        raise ValueError(f"most_edits is 0 to {_LETTERS}")
    left, right = (side.select("id", "name").where("name is not null and name <> ''") for side in (left, right))
    # keys are a hundred times the names that their size is estimated by, and
    # pairs grow with the names: every side is merged, none is broadcast
    met = _keys(left, most_edits, "left").join(_keys(right, most_edits, "right").hint("merge"), "key").where(_disjoint(most_edits)).select("left_id", "right_id")
    named = met.join(right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name")).hint("merge"), "right_id")
    named = named.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name")).hint("merge"), "left_id")
    return named.select("left_id", "right_id", "left_name", "right_name").mapInArrow(lambda batches: _verify(batches, most_edits), "left_id long, right_id long, distance int")


def misspelt(name: str, vendor_id: str) -> Column:
    """The stored name with two neighbours exchanged where the id's crc32 is
    even; their place is its remainder by the pairs of neighbours."""
    h = F.crc32(F.col(vendor_id).cast("string").cast("binary"))
    size = F.length(name)
    at = (h % F.greatest(size - 1, F.lit(1))).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, size))
    return F.when((h % 2 == 0) & (size >= 2), swapped).otherwise(F.col(name))


def join_names(clients: DataFrame, vendors: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """Per vendor and exact distance the clients whose names are so far from
    the vendor's: vendor_id, distance, n_clients, first_client_id, clients_crc.

    Rows whose id or name is null or whose name is empty take no part.  Rows
    that repeat an id and a name count once; an id with several names counts
    with each of them.  Clients of one name are counted before names are
    joined, so a name that a third of all rows bears is one name.  Empty tables
    give no row; other columns, whatever their names, are ignored.
    """

    def distinct(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("of"), F.col("name").cast("string").alias("name"))
        return rows.where("of is not null and name is not null and name <> ''").distinct()

    # an id given by place would change if a task ran again, so it is stored
    number = F.monotonically_increasing_id().alias("id")
    crc = F.crc32(F.col("of").cast("string").cast("binary"))
    left = distinct(clients, "client_id").groupBy("name").agg(F.count("*").alias("n_clients"), F.min("of").alias("first_client_id"), F.sum(crc).alias("clients_crc"))
    left = written(left.select(number, "*"), "client-names")
    spelt = written(distinct(vendors, "vendor_id").select(F.col("of").alias("vendor_id"), misspelt("name", "of").alias("name")), "vendors")
    right = written(spelt.select("name").distinct().select(number, "name"), "vendor-names")
    pairs = written(similar_names(left, right, most_edits), "name-pairs")
    counts = pairs.join(left.select(F.col("id").alias("left_id"), "n_clients", "first_client_id", "clients_crc").hint("merge"), "left_id")
    totals = (F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))
    counts = counts.groupBy("right_id", "distance").agg(*totals)
    of_name = right.select(F.col("id").alias("right_id"), "name")
    out = spelt.join(of_name.hint("merge"), "name").join(counts.hint("merge"), "right_id").groupBy("vendor_id", "distance").agg(*totals)
    out = written(out, "vendor-distances")
    discard(left, spelt, right, pairs)
    return out


def op13_anagram_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by the names of vendors, at most two edits apart (see
    ``join_names`` for nulls, repeated rows and empty tables)."""
    return join_names(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


# crc32 bit by bit over the digits; distances row by row of the table of
# prefixes, whose entries above 2 count as 3
OP13_SQL = """
WITH RECURSIVE crc_of AS MATERIALIZED (
  SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(id::VARCHAR) + 1),
    lambda p: list_transform(range(0, 8), lambda k: (unicode(substr(id::VARCHAR, p, 1)) >> k) & 1)))),
    lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) AS crc
  FROM (SELECT client_id::BIGINT AS id FROM clients UNION SELECT vendor_id::BIGINT FROM vendors) WHERE id IS NOT NULL),
c AS (SELECT DISTINCT client_id, name, crc FROM clients JOIN crc_of ON id = client_id WHERE name <> ''),
v AS (SELECT DISTINCT vendor_id, CASE WHEN crc % 2 = 0 AND length(name) >= 2 THEN
    substr(name, 1, (crc % (length(name) - 1))::INT) || substr(name, (crc % (length(name) - 1))::INT + 2, 1)
    || substr(name, (crc % (length(name) - 1))::INT + 1, 1) || substr(name, (crc % (length(name) - 1))::INT + 3) ELSE name END AS name
  FROM vendors JOIN crc_of ON id = vendor_id WHERE name <> ''),
cn AS (SELECT name, string_split(name, '') AS x, count(*) AS n_clients, min(client_id) AS first_client_id, sum(crc)::BIGINT AS clients_crc FROM c GROUP BY name),
vn AS (SELECT DISTINCT name, string_split(name, '') AS y FROM v),
steps AS (
  SELECT cn.name AS client, vn.name AS vendor, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: least(j, 3)) AS now, CAST(NULL AS BIGINT[]) AS before
  FROM cn JOIN vn ON abs(len(x) - len(y)) <= 2
  UNION ALL
  SELECT client, vendor, x, y, i + 1, list_transform(range(0, len(base) + 0), lambda j: least(base[j + 1], CASE WHEN j >= 1 THEN base[j] + 1 ELSE 3 END, CASE WHEN j >= 2 THEN base[j - 1] + 2 ELSE 3 END, 3)), now
  FROM (SELECT *, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN least(i + 1, 3) ELSE least(now[j + 1] + 1, now[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND j >= 2 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN before[j - 1] + 1 ELSE 3 END, 3) END) AS base
    FROM steps WHERE i < len(x) AND list_min(now) <= 2)),
pairs AS (SELECT client, vendor, now[len(y) + 1]::INT AS distance FROM steps WHERE i = len(x) AND now[len(y) + 1] <= 2)
SELECT vendor_id, distance, sum(n_clients)::BIGINT AS n_clients, min(first_client_id)::BIGINT AS first_client_id, sum(clients_crc)::BIGINT AS clients_crc
FROM pairs JOIN cn ON cn.name = client JOIN v ON v.name = vendor GROUP BY ALL
"""
