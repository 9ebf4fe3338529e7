"""Near-duplicate documents: exact Jaccard join on word shingles.

Candidates come from adaptive prefixes with several required matches.  A
document orders its shingles from rare to frequent and publishes the first
``n - ceil(t n) + l`` of them; two documents of similarity t or more share at
least ``min(l, l')`` published shingles.  ``l`` is chosen document by document
from estimated costs: a longer prefix costs postings and saves verifications.

Equal sets are one class from the start.  Members of long posting lists meet
in blocks first, where sets are compared exactly and a class that is already
connected to another is compared no more, so that a large group of near copies
costs about as many comparisons as it has members.  After that a list gives
the pairs that aren't connected yet.  Pairs found in enough lists go through a
bound from their signatures.  First the best pair of each class is verified and,
of a long list, the pairs that would connect its members; then all pairs that
this didn't connect.

A signature is a bitmap of the parities of shingles by hash.  The difference
of two sets is at least as large as that of their bitmaps, which bounds the
intersection from above: the test loses no pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from faultline.llm.shared import bounded_batches, connected_components, discard, release, release_plans, slices, table, text_buffer, written
from faultline.llm.words import ngram_hashes, word_hashes

SHINGLE, PERCENT = 3, 90
MOST_MATCHES = 4
#: the frequency sketch: counters by leading hash bits, sent in ranges.  It
#: has 2**SKETCH_BITS counters, and from SKETCH_ROWS documents on twice as many
#: for each doubling, up to 2**MOST_SKETCH_BITS
SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_ROWS, RANGE_BITS = 20, 24, 1 << 20, 14
#: words of the bitmap of wanted rows
FILTER_WORDS = 1 << 17
#: members and shingles of a block; larger ones are split by hash around
#: common pivots
BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 1 << 20, 16
#: up to so many members a list is short
SHORT = 64
#: shingles that the sketch counts as often as this, and as 8 counters on
#: average, may have lists too long for one task, and go to so many
HOT, HOT_PARTS = 1 << 15, 1024
#: bits of the smallest signature, and of those that long lists compare
SIGNATURE = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Each document's sorted distinct shingle hashes; a text of fewer words
    is one shingle, a text without words has none."""
    words, first, _, _ = word_hashes(data, offsets)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        own = words[lo:hi]
        yield np.unique(ngram_hashes(own, min(size, len(own)))) if len(own) else own


def document_sets(batch, size: int):
    """(doc_id, set) of each row of an Arrow batch (doc_id, text)."""
    ids = batch.column(0)
    data, offsets = text_buffer(batch.column(1))
    for lo, hi in slices(offsets, 1 << 18):
        sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        yield from zip(ids.slice(lo, hi - lo).to_pylist(), sets)


def class_key(shingles: np.ndarray) -> int:
    """64 bits of the whole sorted set, as a signed long."""
    import xxhash

    key = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))
    return key - (1 << 64) if key >> 63 else key


def needed(n, percent: int):
    """Shingles a set of size n shares with any set of that similarity."""
    return -(-n * percent // 100)


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int, most: int = MOST_MATCHES) -> tuple[np.ndarray, int]:
    """(published shingles, required matches).

    The estimated cost of l matches is the postings read (the shingles'
    frequencies) plus the verifications: at most postings / l documents have
    l matches, and one verification costs about n / 8 postings.
    """
    n = len(shingles)
    base = n - needed(n, percent)
    top = min(n, base + most)
    if top < n:
        nearest = np.argpartition(counts, top - 1)[: top]
        edge = counts[nearest].max()
        nearest = np.flatnonzero(counts <= edge)  # ties are ordered by hash
    else:
        nearest = np.arange(n)
    order = nearest[np.lexsort((shingles[nearest], counts[nearest]))][:top]
    read = np.cumsum(counts[order].astype(np.float64))
    matches = np.arange(1, top - base + 1)
    cost = read[base:] * (1 + n / 8 / matches)
    best = int(np.argmin(cost))
    return shingles[order[: base + best + 1]], best + 1


def signature_bits(n: int, percent: int) -> int:
    """A power of two of about four times the difference of two similar sets."""
    return max(SIGNATURE, 1 << (8 * n * (100 - percent) // (100 + percent)).bit_length())


def signature(shingles: np.ndarray, percent: int) -> bytes:
    bits = signature_bits(len(shingles), percent)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature's bytes as those of fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def differing(x: bytes, y: bytes) -> int:
    """The least size of the difference of two sets, by their signatures."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    return int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum(dtype=np.int64))


def _signatures(size: int, percent: int, sketch_bits: int):
    """Rows of documents and, at the end of the task, of its sketch."""

    def run(batches):
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        shift = np.uint64(64 - sketch_bits)
        names = ["doc_id", "place", "n", "key", "signature", "range", "counts"]

        def count(pending):
            places = (np.concatenate(pending) >> shift).astype(np.int64)
            if len(places) > len(sketch) // 8:
                np.add(sketch, np.bincount(places, minlength=len(sketch)).astype(np.uint32), out=sketch)
            else:
                np.add.at(sketch, places, np.uint32(1))

        for batch in batches:
            sizes, keys, bits, pending, held = [], [], [], [], 0
            for _, own in document_sets(batch, size):
                sizes.append(len(own))
                keys.append(class_key(own) if len(own) else None)
                bits.append(signature(own, percent) if len(own) else None)
                pending.append(own)
                held += len(own)
                if held > 1 << 19:
                    count(pending)
                    pending, held = [], 0
            if held:
                count(pending)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names
            )
        if sketch.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(-1, 1 << RANGE_BITS)]
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([*[none.cast(pa.int64())] * 4, none.cast(pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)
        release()

    return run


def _sum_ranges(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << RANGE_BITS, np.int64)
    for batch in batches:
        for part in batch.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(part), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["range", "counts"])


def similar(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def link_block(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect just the members that all links connect.

    Members go by size.  Each is compared with one member of every group
    found so far, and with the others of the groups that this didn't link.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    if len(order) == 2:
        a, b = (sets[i] for i in order)
        if 100 * sizes[0] < percent * sizes[1]:
            return []
        return [(order[0], order[1])] if similar(len(np.intersect1d(a, b, assume_unique=True)), *sizes.tolist(), percent) else []
    values, column = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    times = np.bincount(column, minlength=len(values))
    place = np.cumsum(times > 1) - 1  # shingles of one member are no overlap
    row = np.repeat(np.arange(len(order)), sizes)
    inside = times[column] > 1
    row, column = row[inside], place[column[inside]]
    bits = np.zeros((len(order), int(place[-1]) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    group = np.arange(len(order))
    links: list[tuple[int, int]] = []

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        hits = []
        for lo in range(0, len(others), 256):
            part = others[lo : lo + 256]
            common = np.bitwise_count(bits[part] & bits[i]).sum(axis=1, dtype=np.int64)
            hits.append(part[similar(common, sizes[i], sizes[part], percent)])
        return np.concatenate(hits) if hits else others

    for i in range(1, len(order)):
        lo = int(np.searchsorted(100 * sizes[:i], percent * sizes[i]))
        window = np.arange(lo, i)
        if not len(window):
            continue
        found, at = np.unique(group[window], return_index=True)
        hit = linked(i, window[at])
        rest = window[~np.isin(group[window], group[hit])]
        rest = rest[~np.isin(rest, window[at])]
        if len(rest):
            more = linked(i, rest)
            hit = np.concatenate((hit, more[np.unique(group[more], return_index=True)[1]]))
        if len(hit):
            links += [(order[i], order[j]) for j in hit.tolist()]
            joined = np.unique(group[hit])
            group[: i][np.isin(group[:i], joined)] = joined[0]
            group[i] = joined[0]
    return links


def _block_links(percent: int, size: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets = [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            sets += [own for _, own in document_sets(batch.select(["key", "text"]), size)]
        links = link_block(sets, percent) if len(sets) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in links], pa.int64()), pa.array([keys[j] for _, j in links], pa.int64())], ["a", "b"])

    return run


def candidates(n: np.ndarray, label: np.ndarray, bits: np.ndarray, mine: np.ndarray, other: np.ndarray, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members that aren't connected, fit in size and may be
    similar by their signatures, one of each pair marked in ``mine`` and the
    other in ``other``.  With ``forest`` a pair that earlier ones connect is
    left out, and of those that connect the same the most similar one stays."""
    order = np.argsort(n, kind="stable")
    n, bits, mine, other = n[order], bits[order], mine[order], other[order]
    group = np.unique(label[order], return_inverse=True)[1]
    first, second = [], []
    for i in range(1, len(order)):
        lo = int(np.searchsorted(100 * n[:i], percent * n[i]))
        j = lo + np.flatnonzero((group[lo:i] != group[i]) & ((mine[i] & other[lo:i]) | (other[i] & mine[lo:i])))
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            close = similar((n[i] + n[j] - apart) // 2, n[i], n[j], percent)
            j, apart = j[close], apart[close]
        if len(j) and forest:
            nearest = np.lexsort((apart / (n[i] + n[j]),))
            found, at = np.unique(group[j[nearest]], return_index=True)
            j = j[nearest[at]]
            group[np.isin(group, found)] = group[i]
        if len(j):
            first.append(np.full(len(j), i))
            second.append(j)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(first)], order[np.concatenate(second)]


def _list_pairs(percent: int, forest: bool):
    """Pairs of a cell (token, part, chunk) of a long list.  A cell has a part
    of the members with the most frequent label and a chunk of the others; its
    pairs have one of either.  Cells without such a part have two chunks."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        keys, most, chunk = got["key"].to_numpy(), got["most"].to_numpy(zero_copy_only=False).astype(bool), got["own"].to_numpy()
        bits = np.stack([folded(np.frombuffer(x, np.uint8), SIGNATURE // 8) for x in got["signature"].to_pylist()]).view(np.uint64)
        part, second = key[1].as_py(), key[2].as_py()
        mine, other = (most, ~most) if part >= 0 else (chunk == -1 - part, chunk == second)
        i, j = candidates(got["n"].to_numpy().astype(np.int64), got["label"].to_numpy(), bits, mine, other, percent, forest)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[i], keys[j])), pa.array(np.maximum(keys[i], keys[j]))], ["a", "b"])

    return run


def long_pairs(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b), once for each list they share, of unconnected members of lists
    (token, key, n, label, signature) that may be similar; with ``forest`` no
    more of a cell than connect what all of them connect."""
    sizes = members.groupBy("token", "label").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("token").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("open"))
    sizes = sizes.select(
        "token", F.col("top.label").alias("top"),
        F.ceil(F.col("top.size") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("open") - F.col("top.size")) / BLOCK).cast("int").alias("chunks"),
    ).where("chunks > 0")
    rows = members.join(sizes, "token").withColumn("most", F.col("label") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("most"), F.col("parts")).otherwise(F.col("chunks"))).cast("int"))
    upto = lambda top: F.sequence(F.lit(0), F.col(top) - 1)
    cell = lambda part, chunk: F.struct(part.cast("int").alias("part"), chunk.cast("int").alias("chunk"))
    cells = F.when(F.col("most"), F.transform(upto("chunks"), lambda c: cell(F.col("own"), c))).otherwise(
        F.concat(
            F.transform(upto("parts"), lambda p: cell(p, F.col("own"))),
            F.transform(upto("chunks"), lambda c: cell(-1 - F.least(c, F.col("own")), F.greatest(c, F.col("own")))),
        )
    )
    dealt = rows.withColumn("cell", F.explode(cells)).select("token", "cell.part", "cell.chunk", "own", "most", "key", "n", "label", "signature")
    return dealt.groupBy("token", "part", "chunk").applyInArrow(_list_pairs(percent, forest), "a long, b long")


def _verify(percent: int, size: int):
    def run(batches):
        for batch in batches:
            first = [own for _, own in document_sets(batch.select(["a", "text_a"]), size)]
            second = [own for _, own in document_sets(batch.select(["b", "text_b"]), size)]
            good = [bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)) for x, y in zip(first, second)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``wanted`` (place, ...) with the text of that place.

    A bitmap of FILTER_WORDS words, whatever the number of rows, leaves out
    most other texts where they are read, before the join moves any; when it
    fills up it just leaves out fewer.  Rows repeated in documents count once.
    """
    slot = F.pmod("place", F.lit(FILTER_WORDS))
    bit = F.pmod(F.shiftright("place", 32), F.lit(64)).cast("int")
    bits = wanted.groupBy(slot.alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(shiftright(place, 32), 64) as int)))").alias("bits"))
    some = docs.withColumn("slot", slot).join(F.broadcast(bits), "slot").where(F.getbit("bits", bit) == 1)  # FILTER_WORDS rows at most
    return some.groupBy("place").agg(F.first("text").alias("text")).join(wanted, "place")


def with_keys(docs: DataFrame, size: int) -> DataFrame:
    """All columns of documents and the ``key`` of each row's set."""

    def run(batches):
        for batch in batches:
            text = batch.select(["doc_id", "text"])
            own = [class_key(s) if len(s) else None for _, s in document_sets(text, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("key", LongType())]))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see
    ``near_duplicate_rows``."""
    return near_duplicate_rows(docs, percent, size).select("doc_id", "n_shingles", "component_id")


def listed_postings(postings: DataFrame, percent: int) -> DataFrame:
    """(token, key, n, matches, hot, length, least) of lists of at least two
    classes and in them of members with a neighbour in size: others have no
    partner there.  Tasks may have published a class more than once.  Lists
    that may be hot are dealt over HOT_PARTS; their rows all stay, and their
    length and least are those of a part."""
    of_list = Window.partitionBy("token", "salt")
    by_size = of_list.orderBy("n", "key")
    near = (100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after"))
    return (
        postings.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
        .withColumn("low", F.min("key").over(of_list)).withColumn("high", F.max("key").over(of_list)).where("hot or low <> high")
        .withColumn("before", F.lag("n").over(by_size)).withColumn("after", F.lead("n").over(by_size)).where(F.col("hot") | near)
        .groupBy("token", "salt", "key").agg(*[F.first(c).alias(c) for c in ("n", "matches", "hot")])
        .withColumn("length", F.count("*").over(of_list)).withColumn("least", F.min("matches").over(of_list)).where("hot or length > 1").drop("salt")
    )


def whole_lists(listed: DataFrame) -> DataFrame:
    """The length and least of hot lists from those of their parts."""
    parts = listed.where("hot").groupBy("token").agg(F.count("*").alias("whole"), F.min("least").alias("all"))
    rows = listed.join(parts, "token", "left").withColumn("length", F.coalesce("whole", "length")).withColumn("least", F.coalesce("all", "least"))
    return rows.drop("whole", "all").where("length > 1")


def near_duplicate_rows(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, component) of every document:
    ``key`` names the row's set, ``component`` what it is linked with.

    Documents link when 100 * intersection >= percent * union of their
    distinct shingles.  ``component_id`` is the smallest doc_id reachable by
    links, the document's own if there are none.

    Nulls: a null or wordless text has no shingle and links with nothing; a
    null doc_id takes part and names no component.  Rows repeated under one
    id each give a row.  An empty table gives no rows; other columns are
    ignored.  Ties in rarity go to the smaller hash.  Sets are told apart by
    64-bit hashes of shingles and of sets, rows by 64 bits of id and text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("place"))
    bounded_batches(spark)
    sketch_bits = min(SKETCH_BITS + max(docs.count() // SKETCH_ROWS, 0).bit_length(), MOST_SKETCH_BITS)
    both = written(docs.mapInArrow(_signatures(size, percent, sketch_bits), "doc_id long, place long, n long, key long, signature binary, range int, counts binary"), "signatures")
    documents = both.where("range is null").select("doc_id", "place", "n", "key", "signature")
    # 2**sketch_bits counters in all
    sketch = np.zeros(1 << sketch_bits, np.uint32)
    for r in both.where("range is not null").select("range", "counts").groupBy("range").applyInArrow(_sum_ranges, "range int, counts binary").collect():
        sketch[r["range"] << RANGE_BITS : (r["range"] + 1) << RANGE_BITS] = np.frombuffer(r["counts"], np.uint32)
    hot = max(HOT, 8 * int(sketch.mean(dtype=np.float64)))
    shared = spark.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - sketch_bits)

    def publish(batches):
        counts, seen = shared.value, set()
        for batch in batches:
            rows, at, tokens, often = [], [], [], []
            for _, own in document_sets(batch, size):
                # sets too small to differ and still be similar are classes
                if len(own) == 0 or needed(len(own) + 1, percent) > len(own):
                    continue
                key = class_key(own)
                if key in seen:
                    continue
                seen.add(key)
                chosen, matches = prefix(own, counts[(own >> shift).astype(np.int64)], percent)
                tokens.append(chosen)
                often.append(counts[(chosen >> shift).astype(np.int64)] >= hot)
                rows.append((key, len(own), matches))
                at.append(len(chosen))
            if rows:
                columns = [np.repeat(np.array([r[k] for r in rows], np.int64), at) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(np.concatenate(often))],
                    ["token", "key", "n", "matches", "hot"],
                )
        release()

    postings = docs.select("doc_id", "text").mapInArrow(publish, "token long, key long, n int, matches int, hot boolean")
    rows = listed = written(listed_postings(postings, percent), "listed")
    shared.unpersist()
    if (sketch >= hot).any():
        listed = whole_lists(listed)
    # a class with a partner is in as many lists as the pair has to share
    enough = listed.groupBy("key").agg(F.count("*").alias("lists"), F.min(F.least("matches", "least")).alias("required")).where("lists >= required").select("key")
    active = written(listed.join(enough, "key").drop("least", "hot"), "active")
    discard(rows)
    release_plans(docs.sparkSession)
    classes = documents.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"))
    # copies are merged where they are read, before the join moves any
    merged = documents.where("key is not null").groupBy("key").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    signed = written(merged.join(active.select("key").distinct(), "key", "left_semi"), "signed")

    links, labels = None, None
    crowd = active.where(F.col("length") > SHORT)
    if crowd.take(1):
        # each class of a long list goes to the longest that it is in
        home = crowd.groupBy("key").agg(F.max(F.struct("length", "token")).alias("home"), F.first("n").alias("n")).select("key", "home.token", "n")
        sizes = home.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
        home = written(home.join(sizes, "token").select("key", "token", "parts", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part")), "homes")
        # the smallest keys of a part of a split list go to all of its parts
        least = home.where("parts > 1 and part = 0").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("key"))).where(F.col("rank") <= PIVOTS)
        spread = least.select("key", "token", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("part"))
        members = home.select("key", "token", "part").unionByName(spread)
        members = written(members.join(signed.select("key", "place"), "key"), "members")
        links = written(texts_of(docs, members).groupBy("token", "part").applyInArrow(_block_links(percent, size), "a long, b long"), "links")
        discard(home, members)
        labels = connected_components(links)
        release_plans(docs.sparkSession)

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("key"))
        own = labels.select(F.col("node").alias("key"), F.col("component").alias("label"))
        return rows.join(own, "key", "left").withColumn("label", F.coalesce("label", "key"))

    # pairs of a list: short ones by a join, long ones by signatures in Python
    asked = active.groupBy("key").agg(F.first("matches").alias("matches"), F.max("length").alias("longest")).join(signed, "key")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Counted pairs that may be in enough lists, and may be similar."""
        for side in ("a", "b"):
            pairs = pairs.join(asked.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("matches", "longest", "place", "n", "signature")]), side)
        pairs = pairs.withColumn("required", F.least("matches_a", "matches_b"))
        pairs = pairs.where((F.col("shared") >= F.col("required")) | (~F.col("whole") & (F.least("longest_a", "longest_b") > SHORT)))
        return pairs.mapInArrow(_bounded(percent), "a long, b long, shared long, required int, place_a long, place_b long")

    open_ = labelled(active)
    x, y = (open_.where(F.col("length") <= SHORT).alias(name) for name in ("x", "y"))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & (100 * small >= percent * large)
    pairs = x.join(y, on).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = written(bounded(pairs.withColumn("whole", F.lit(labels is None))), "pairs")
    places = signed.select("key", "place")

    def placed(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(places.select(F.col("key").alias(side), F.col("place").alias(f"place_{side}")), side)
        return pairs

    # the best pair of each class
    sure = pairs.where("shared >= required")
    pair = F.struct("shared", F.xxhash64("a", "b").alias("tie"), "a", "b", "place_a", "place_b").alias("pair")
    ends = sure.select(F.col("a").alias("key"), pair).unionByName(sure.select(F.col("b").alias("key"), pair))
    todo = ends.groupBy("key").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b", "pair.place_a", "pair.place_b")

    def long_lists() -> DataFrame:
        rows = labelled(active.where(F.col("length") > SHORT)).drop("n").join(signed, "key")
        return rows.select("token", "key", "n", "label", "signature")

    crowded = labels is not None
    if crowded:
        todo = todo.unionByName(placed(long_pairs(long_lists(), percent, True).distinct()).select("a", "b", "place_a", "place_b"))
    todo = written(todo.distinct(), "best")
    done = []
    while todo.take(1):
        proven = written(_proven(docs, todo, percent, size), "links")
        links = proven if links is None else links.unionByName(proven)
        discard(labels)
        labels = connected_components(links)
        release_plans(docs.sparkSession)
        done.append(todo)
        if len(done) == 2:
            break
        # then whatever is still apart
        own = labels.select("node", "component")
        rest = pairs
        for side in ("a", "b"):
            rest = rest.join(own.select(F.col("node").alias(side), F.col("component").alias(f"label_{side}")), side, "left")
        rest = rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "shared")
        if crowded:
            more = long_pairs(long_lists(), percent, False).groupBy("a", "b").agg(F.count("*").alias("shared"))
            rest = rest.unionByName(more).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        rest = rest.join(todo.select("a", "b"), ["a", "b"], "left_anti").withColumn("whole", F.lit(True))
        todo = written(bounded(rest).select("a", "b", "place_a", "place_b"), "rest")
    discard(active, signed, pairs, *done)
    if labels is None:
        named = classes.select("key", "doc_id", F.col("key").alias("component"))
    else:
        named = classes.join(labels, classes["key"] == labels["node"], "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "component").select("key", "component_id", "component")
    return documents.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "component"
    )


def _bounded(percent: int):
    """Leaves out pairs whose signatures differ too much."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(f"n_{s}").to_numpy() for s in "ab")
            apart = np.fromiter(map(differing, batch.column("signature_a").to_pylist(), batch.column("signature_b").to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["a", "b", "shared", "required", "place_a", "place_b"]).filter(pa.array(similar((n + m - apart) // 2, n, m, percent)))

    return run


def _proven(docs: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b, place_a, place_b) that are similar."""
    sides = [pairs.select(F.col(f"place_{s}").alias("place"), "a", "b", F.lit(s).alias("side")) for s in "ab"]
    texts = texts_of(docs, sides[0].unionByName(sides[1])).groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == s, F.col("text"))).alias(f"text_{s}") for s in "ab"])
    return texts.mapInArrow(_verify(percent, size), "a long, b long")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
