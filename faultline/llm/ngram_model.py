"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the words, level 2 the successors of words, level 3 those of
word pairs; a pointer sequence marks each node's range.  Levels are files of
the shared folder, one for each part of the key space, which scoring tasks map
into memory; what they touch is what they read.  A word below a pair is stored
as its place among the successors of the pair's second word, which makes it a
small number.  Probabilities are interpolated absolute discounting, stored as
quantised logarithms with each context's back-off weight.

Counts cover every training document, and every pair and triple is kept.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.elias_fano import EliasFano
from faultline.llm.shared import bounded_batches, filesystem, release, remove_folder, shared_folder, slices, table, text_buffer, write_file
from faultline.llm.words import mix, word_hashes

FOLDS, HELD_OUT = 5, 1
DISCOUNT, LEAST = 0.75, 1
#: the end of a text is a word, and what a text begins after
END = mix(np.array([5], np.uint64))[0]
SLICE = 1 << 22
#: documents of a part of the key space
PART_ROWS = 8000
#: probabilities are kept in steps of 1/STEPS of log10, in 16 bits
STEPS = 4096
_MAGIC = np.uint64(0x31454952544C46)


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype(np.uint16)


def restore(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) / -STEPS


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays after a header of their kinds and lengths, 8-byte aligned."""
    kinds = {"uint64": 0, "uint32": 1, "uint16": 2}
    head = [int(_MAGIC), len(arrays)] + [x for a in arrays for x in (kinds[a.dtype.name], len(a))]
    body = [np.array(head, np.uint64).tobytes()]
    for a in arrays:
        raw = a.tobytes()
        body.append(raw + bytes(-len(raw) % 8))
    write_file(uri, b"".join(body))


def load(uri: str) -> list[np.ndarray]:
    """Maps a file; one that isn't on a mounted folder is copied to a
    temporary file without a name first, which goes with the process."""
    store, path = filesystem(uri)
    if store.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(path) as source:
            while chunk := source.read(1 << 24):
                copy.write(chunk)
            copy.flush()
            raw = np.memmap(copy.name, np.uint8, "r")
    head = raw[:16].view(np.uint64)
    if head[0] != _MAGIC:
        raise ValueError(f"{uri} isn't a level")
    shapes = raw[16 : 16 + 16 * int(head[1])].view(np.uint64).reshape(-1, 2).astype(int).tolist()
    at, out = 16 + 16 * int(head[1]), []
    for kind, n in shapes:
        dtype = (np.uint64, np.uint32, np.uint16)[kind]
        size = n * np.dtype(dtype).itemsize
        out.append(np.frombuffer(raw, dtype, n, at))  # a plain array over the map
        at += size + -size % 8
    return out


def by_part(parts: np.ndarray):
    """(part, positions) for each part that occurs."""
    small = len(parts) and int(parts.max()) < 1 << 16  # numbers of 16 bits are sorted by radix
    order = np.argsort(parts.astype(np.uint16) if small else parts, kind="stable")
    found, first = np.unique(parts[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


class Trie:
    """Reads the levels of a folder.  ``bits`` leading bits of a word's hash
    give its part; ids number the words in hash order."""

    def __init__(self, folder: str, bits: int, info: dict):
        self.folder, self.bits, self.info = folder, bits, info
        self.starts = np.array(info["word_starts"], np.int64)
        self.total, self.words = info["tokens"], int(self.starts[-1])
        self.pair_starts = np.array(info.get("pair_starts", [0]), np.int64)
        self.triple_cuts = info.get("triple_parts", 0)
        self.files: dict[str, list] = {}

    def file(self, name: str) -> list[np.ndarray]:
        if name not in self.files:
            self.files[name] = load(f"{self.folder}/{name}")
        return self.files[name]

    # level 1 ---------------------------------------------------------------

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for p, rows in by_part(part):
            if self.starts[p] == self.starts[p + 1]:
                continue
            known, times = self.file(f"words/{p}")
            at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
            hit = known[at] == hashes[rows]
            ids[rows[hit]] = self.starts[p] + at[hit]
            counts[rows[hit]] = times[at[hit]]
        return ids, counts

    def of_ids(self, ids: np.ndarray, kind: str, column: int, empty):
        """A column of the words' files, by id."""
        out = np.full(len(ids), empty)
        for p, rows in by_part(np.searchsorted(self.starts, ids, "right") - 1):
            out[rows] = self.file(f"{kind}/{p}")[column][ids[rows] - self.starts[p]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.words + 1)))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of discounted relative frequency; what the discounts free is
        the probability of an unknown word."""
        free = self.info["discount1"]
        unknown = max(free * self.words, 0.5) / self.total
        return np.log10(np.where(counts > 0, np.maximum(counts - free, 1e-9) / self.total, unknown))

    # level 2 ---------------------------------------------------------------

    def pair_part(self, first: np.ndarray, first_count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Pairs are parted by their first word; a word with more than a
        part's share of the text is dealt by the second word over 8 parts."""
        part = (np.searchsorted(self.starts, first, "right") - 1) * 8
        hot = first_count << self.bits > self.total
        spread = second * 8 // max(self.words, 1)
        return part + np.where(hot, spread, 0)

    def pair_file(self, p: int):
        """(successors, pointers, log probabilities, back-offs)"""
        key = f"pairs/{p}#"
        if key not in self.files:
            a = self.file(f"pairs/{p}")
            self.files[key] = [EliasFano.of_parts(*a[:4]), EliasFano.of_parts(*a[4:8]), *a[8:]]
        return self.files[key]

    def pairs(self, first: np.ndarray, second: np.ndarray, first_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in level 2, place among the successors of the first word);
        -1 where there is no such pair."""
        index, place = np.full(len(first), -1, np.int64), np.full(len(first), -1, np.int64)
        part = self.pair_part(first, first_count, second)
        for p, rows in by_part(part):
            if self.pair_starts[p] == self.pair_starts[p + 1]:
                continue
            successors, pointers = self.pair_file(p)[:2]
            base = int(self.starts[p // 8])
            node = first[rows] - base
            at = successors.find(node.astype(np.uint64) * np.uint64(self.words) + second[rows].astype(np.uint64))
            hit = at >= 0
            index[rows[hit]] = self.pair_starts[p] + at[hit]
            # the pointer of a node is where its successors begin
            begin = pointers.access(node[hit]).astype(np.int64)
            place[rows[hit]] = (at[hit] - begin) * 8 + p % 8
        return index, place

    def of_pairs(self, index: np.ndarray, column: int, empty):
        out = np.full(len(index), empty)
        for p, rows in by_part(np.searchsorted(self.pair_starts, index, "right") - 1):
            out[rows] = self.pair_file(p)[column][index[rows] - self.pair_starts[p]]
        return out

    def pair_counts(self, index: np.ndarray) -> np.ndarray:
        """Training counts of pairs, while the model is built."""
        out = np.zeros(len(index), np.uint64)
        for p, rows in by_part(np.searchsorted(self.pair_starts, index, "right") - 1):
            out[rows] = self.file(f"pair-counts/{p}")[0][index[rows] - self.pair_starts[p]]
        return out

    # level 3 ---------------------------------------------------------------

    def triple_part(self, pair: np.ndarray) -> np.ndarray:
        return pair * self.triple_cuts // max(int(self.pair_starts[-1]), 1)

    def triple_file(self, p: int):
        """(successors, log probabilities, contexts, their back-offs)"""
        key = f"triples/{p}#"
        if key not in self.files:
            a = self.file(f"triples/{p}")
            self.files[key] = [EliasFano.of_parts(*a[:4]), a[4], EliasFano.of_parts(*a[5:9]), a[9]]
        return self.files[key]

    def triple_base(self, part: int) -> int:
        """The first pair of a part."""
        return -(-part * int(self.pair_starts[-1]) // self.triple_cuts)

    def triples(self, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probabilities of successors of pairs; nan if there is none."""
        out = np.full(len(pair), np.nan)
        for p, rows in by_part(self.triple_part(pair)):
            if p not in self.info["triple_files"]:
                continue
            successors, steps = self.triple_file(p)[:2]
            node = (pair[rows] - self.triple_base(p)).astype(np.uint64)
            inside = place[rows] < int(self.info["stride"])
            at = successors.find(node[inside] * np.uint64(self.info["stride"]) + place[rows][inside].astype(np.uint64))
            out[rows[inside][at >= 0]] = restore(steps[at[at >= 0]])
        return out


def pair_backoffs(trie: Trie, pair: np.ndarray) -> np.ndarray:
    """log10 back-off weights of pairs as contexts of level 3; 0 for those
    without successors."""
    out = np.zeros(len(pair))
    for p, rows in by_part(trie.triple_part(pair)):
        if p in trie.info["triple_files"]:
            contexts, steps = trie.triple_file(p)[2:]
            at = contexts.find((pair[rows] - trie.triple_base(p)).astype(np.uint64))
            out[rows[at >= 0]] = restore(steps[at[at >= 0]])
    return out


def sequences(batch, trie: Trie | None = None):
    """For slices of an Arrow batch (doc_id, text): (rows lo, hi, hashes with
    an end after each text, first position of each text)."""
    data, offsets = text_buffer(batch.column(1))
    for lo, hi in slices(offsets, SLICE):
        words, first, _, _ = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = hi - lo
        out = np.full(len(words) + n, END, np.uint64)
        out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
        yield lo, hi, out, first + np.arange(n + 1)


def looked_up(trie: Trie, hashes: np.ndarray):
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.word_ids(distinct)
    return ids[back], counts[back]


def previous(values: np.ndarray, first: np.ndarray, at_start) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    starts = first[:-1]
    out[starts] = at_start
    return out


def _tally(parts: np.ndarray, codes: np.ndarray):
    """(part, codes, counts) of distinct codes, by part."""
    for p, rows in by_part(parts):
        found, times = np.unique(codes[rows], return_counts=True)
        yield p, found, times.astype(np.uint32)


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, without planes of zeros, compressed."""
    values = values.astype(np.uint64)
    planes = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return np.array([len(values), planes], "<u8").tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, planes = np.frombuffer(data, "<u8", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        raw = pa.decompress(data[16:], n * planes, "zstd", asbytes=True)
        out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view(np.uint64).ravel()


class Gathered:
    """Codes and counts of a task by part.  A part's slices are merged when
    they have twice as many codes as after they were merged last; what is sent
    are steps between ascending codes, and counts less one."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.size: dict[int, int] = {}
        self.least: dict[int, int] = {}

    def add(self, part: int, codes: np.ndarray, counts: np.ndarray) -> None:
        held = self.held.setdefault(part, [])
        held.append((codes, counts))
        self.size[part] = self.size.get(part, 0) + len(codes)
        if self.size[part] > max(2 * self.least.get(part, 0), 1 << 16):
            self.held[part] = [merged(held)]
            self.size[part] = self.least[part] = len(self.held[part][0][0])

    def rows(self):
        for part in list(self.held):
            codes, counts = merged(self.held.pop(part))
            steps = np.diff(codes, prepend=np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(steps)], pa.binary()), pa.array([packed(counts - counts.dtype.type(1))], pa.binary())], ["part", "codes", "counts"])


def merged(held) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    codes = np.concatenate([c for c, _ in held])
    counts = np.concatenate([c for _, c in held]).astype(np.uint64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
    sums = np.add.reduceat(counts[order], first) if len(codes) else counts
    return codes[first], narrow(sums)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all fit, else in 64."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)


def of_batches(batches) -> tuple[np.ndarray, np.ndarray]:
    held = [
        (np.cumsum(unpacked(c), dtype=np.uint64), narrow(unpacked(n).astype(np.uint64) + np.uint64(1)))
        for b in batches
        for c, n in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist())
    ]
    return merged(held)


_TALLY = "part int, codes binary, counts binary"
_tries: dict[str, Trie] = {}


def opened(folder: str, bits: int, info: dict, stage: str) -> Trie:
    """One reader for each worker, model and stage of building it."""
    key = f"{folder}#{stage}"
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(folder, bits, info)
    return _tries[key]


def _one_row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == "part" else pa.int64()) for k, v in columns.items()], list(columns))


def fit(docs: DataFrame, held_out: int = HELD_OUT, folds: int = FOLDS, parts: int | None = None) -> tuple[str, int, dict]:
    """Builds the trie from the documents outside the held-out fold;
    returns (folder, bits, info).  info has one entry a part."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark, "ngrams")
    training = docs.where(F.coalesce(fold(folds), F.lit(-1)) != held_out).select("doc_id", "text")
    rows = training.count()
    bits = max((parts or rows // PART_ROWS).bit_length(), 2)

    def words(batches):
        kept = Gathered()
        for batch in batches:
            for _, _, hashes, _ in sequences(batch):
                for p, codes, counts in _tally((hashes >> np.uint64(64 - bits)).astype(np.int64), hashes):
                    kept.add(p, codes, counts)
        yield from kept.rows()
        release()

    def words_level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = of_batches(batches)
        save(f"{folder}/words/{key[0].as_py()}", [codes, counts])
        yield _one_row(part=key[0].as_py(), n=len(codes), tokens=int(counts.sum(dtype=np.int64)), once=int((counts == 1).sum()), twice=int((counts == 2).sum()))

    made = training.mapInArrow(words, _TALLY).groupBy("part").applyInArrow(words_level, "part int, n long, tokens long, once long, twice long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in made:
        sizes[r["part"]] = r["n"]
    once, twice = sum(r["once"] for r in made), sum(r["twice"] for r in made)
    info = {
        "word_starts": [0, *np.cumsum(sizes).tolist()], "tokens": sum(r["tokens"] for r in made),
        "discount1": min(max(once / max(once + 2 * twice, 1), 0.1), 0.95), "triple_files": [], "stride": 1,
    }
    if not made:
        return folder, bits, info

    def pair_counts(batches):
        trie, kept = opened(folder, bits, info, "words"), Gathered()
        end, end_count = (x[0] for x in trie.word_ids(np.array([END])))
        for batch in batches:
            for _, _, hashes, first in sequences(batch):
                ids, counts = looked_up(trie, hashes)
                left, left_count = previous(ids, first, end), previous(counts, first, end_count)
                # words of training texts are all known
                often = (counts >= LEAST) & (left_count >= LEAST)
                a, b, n = left[often], ids[often], left_count[often]
                for p, codes, times in _tally(trie.pair_part(a, n, b), a.astype(np.uint64) * np.uint64(trie.words) + b.astype(np.uint64)):
                    kept.add(p, codes, times)
        yield from kept.rows()
        release()

    def pair_raw(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the pairs; a dealt context's sums go to the driver."""
        trie, p = opened(folder, bits, info, "words"), key[0].as_py()
        codes, counts = of_batches(batches)
        often = counts >= LEAST
        codes, counts = codes[often], counts[often]
        save(f"{folder}/raw/{p}", [codes, counts])
        a = (codes // np.uint64(trie.words)).astype(np.int64)
        contexts, begin = np.unique(a, return_index=True)
        sums = np.add.reduceat(counts.astype(np.float64) - DISCOUNT, begin) if len(a) else np.zeros(0)
        hot = trie.of_ids(contexts, "words", 1, np.uint64(0)).astype(np.int64) << bits > trie.total
        most = int(np.diff(np.append(begin, len(a))).max()) if len(a) else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([p], pa.int32()), pa.array([len(codes)]), pa.array([most]), pa.array([contexts[hot].tolist()], pa.list_(pa.int64())), pa.array([sums[hot].tolist()], pa.list_(pa.float64()))],
            ["part", "n", "most", "hot", "sums"],
        )

    made = training.mapInArrow(pair_counts, _TALLY).groupBy("part").applyInArrow(pair_raw, "part int, n long, most long, hot array<long>, sums array<double>").collect()
    sizes = np.zeros(8 << bits, np.int64)
    dealt: dict[int, float] = {}
    for r in made:  # at most 2**bits dealt words, in 8 parts each
        sizes[r["part"]] = r["n"]
        for a, s in zip(r["hot"], r["sums"]):
            dealt[a] = dealt.get(a, 0.0) + s
    info = info | {"pair_starts": [0, *np.cumsum(sizes).tolist()], "stride": 8 * (max(r["most"] for r in made) + 1), "hot": dealt}
    if not sizes.any():
        return folder, bits, info
    info["triple_parts"] = 1 << bits

    def pair_level(batches):
        """Writes the successors, pointers, probabilities and, for the words
        of the part, back-offs."""
        trie = opened(folder, bits, info, "raw")
        for batch in batches:
            for p in batch.column(0).to_pylist():
                if not sizes[p]:
                    yield _one_row(part=p)
                    continue
                codes, counts = trie.file(f"raw/{p}")
                base, nodes = int(trie.starts[p // 8]), int(trie.starts[p // 8 + 1] - trie.starts[p // 8])
                a, b = (codes // np.uint64(trie.words)).astype(np.int64), (codes % np.uint64(trie.words)).astype(np.int64)
                of_a = trie.of_ids(a, "words", 1, np.uint64(0)).astype(np.float64)
                weight = context_weights(trie, p, a, counts, of_a)
                p1 = 10 ** trie.unigram(trie.of_ids(b, "words", 1, np.uint64(0)).astype(np.float64))
                probability = (counts - DISCOUNT) / of_a + weight * p1
                pointers = np.searchsorted(a, base + np.arange(nodes + 1))
                successors = codes - np.uint64(base) * np.uint64(trie.words)
                contexts, begin = np.unique(a, return_index=True)
                backoff = np.zeros(nodes)
                backoff[contexts - base] = np.log10(np.maximum(weight[begin], 1e-9))
                save(f"{folder}/pairs/{p}", [*EliasFano.build(successors).parts(), *EliasFano.build(pointers).parts(), quantise(np.log10(probability)), quantise(backoff)])
                save(f"{folder}/pair-counts/{p}", [np.array(counts)])
                yield _one_row(part=p)

    every = spark.createDataFrame([(int(p),) for p in np.flatnonzero(sizes)], "part int").repartition(min(int((sizes > 0).sum()), 1 << bits))
    every.mapInArrow(pair_level, "part int").count()
    remove_folder(spark, f"{folder}/raw")

    def triple_counts(batches):
        trie, kept = opened(folder, bits, info, "pairs"), Gathered()
        for batch in batches:
            for _, _, hashes, first in sequences(batch):
                pair, place = pair_lookup(trie, hashes, first)[2:4]
                left = previous(pair, first, -1)
                both = (left >= 0) & (place >= 0)
                for p, codes, times in _tally(trie.triple_part(left[both]), left[both].astype(np.uint64) * np.uint64(info["stride"]) + place[both].astype(np.uint64)):
                    kept.add(p, codes, times)
        yield from kept.rows()
        release()

    def triple_level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, p = opened(folder, bits, info, "pairs"), key[0].as_py()
        codes, counts = of_batches(batches)
        often = counts >= LEAST
        codes, counts = codes[often], counts[often]
        if len(codes):
            stride = np.uint64(info["stride"])
            pair, place = (codes // stride).astype(np.int64), (codes % stride).astype(np.int64)
            of_pair = trie.pair_counts(pair).astype(np.float64)
            contexts, begin = np.unique(pair, return_index=True)
            sums = np.add.reduceat(counts - DISCOUNT, begin)
            weight = np.maximum(1 - sums / of_pair[begin], 1e-9)
            shorter = 10 ** restore(second_pair_steps(trie, pair, place))
            probability = (counts - DISCOUNT) / of_pair + np.repeat(weight, np.diff(np.append(begin, len(pair)))) * shorter
            base = trie.triple_base(p)
            save(
                f"{folder}/triples/{p}",
                [*EliasFano.build(codes - np.uint64(base) * stride).parts(), quantise(np.log10(np.minimum(probability, 1.0))), *EliasFano.build((contexts - base).astype(np.uint64)).parts(), quantise(np.log10(weight))],
            )
        yield _one_row(part=p, n=len(codes))

    made = training.mapInArrow(triple_counts, _TALLY).groupBy("part").applyInArrow(triple_level, "part int, n long").collect()
    info["triple_files"] = sorted(r["part"] for r in made if r["n"])
    remove_folder(spark, f"{folder}/pair-counts")
    return folder, bits, info


def context_weights(trie: Trie, part: int, a: np.ndarray, counts: np.ndarray, of_a: np.ndarray) -> np.ndarray:
    """The interpolation weight of each row's context."""
    contexts, begin = np.unique(a, return_index=True)
    sums = np.add.reduceat(counts - DISCOUNT, begin)
    for i, c in enumerate(contexts.tolist()):
        if c in trie.info["hot"]:
            sums[i] = trie.info["hot"][c]
    weight = np.maximum(1 - sums / of_a[begin], 1e-9)
    return np.repeat(weight, np.diff(np.append(begin, len(a))))


def second_pair_steps(trie: Trie, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Quantised probabilities of (second word of the pair, successor), whose
    place among that word's successors is given."""
    second = np.empty(len(pair), np.int64)
    for p, rows in by_part(np.searchsorted(trie.pair_starts, pair, "right") - 1):
        successors = trie.pair_file(p)[0]
        second[rows] = (successors.access(pair[rows] - trie.pair_starts[p]) % np.uint64(trie.words)).astype(np.int64)
    part = (np.searchsorted(trie.starts, second, "right") - 1) * 8 + place % 8
    out = np.zeros(len(pair), np.uint16)
    for p, rows in by_part(part):
        pointers, steps = trie.pair_file(p)[1:3]
        begin = pointers.access(second[rows] - trie.starts[p // 8]).astype(np.int64)
        out[rows] = steps[begin + place[rows] // 8]
    return out


def pair_lookup(trie: Trie, hashes: np.ndarray, first: np.ndarray):
    """(ids, counts, pair index, place) of each word after the one before."""
    ids, counts = looked_up(trie, hashes)
    end = trie.word_ids(np.array([END]))
    left, left_count = previous(ids, first, end[0][0]), previous(counts, first, end[1][0])
    pair, place = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
    often = np.flatnonzero((counts >= LEAST) & (left_count >= LEAST))
    if len(often) and trie.triple_cuts:
        code = left[often].astype(np.uint64) * np.uint64(trie.words) + ids[often].astype(np.uint64)
        _, where, back = np.unique(code, return_index=True, return_inverse=True)
        own = often[where]
        index, at = trie.pairs(left[own], ids[own], left_count[own])
        pair[often], place[often] = index[back], at[back]
    return ids, counts, pair, place, left, left_count


def log_probabilities(trie: Trie, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of each word."""
    _, counts, pair, place, left, left_count = pair_lookup(trie, hashes, first)
    out = trie.unigram(counts)
    if not trie.triple_cuts:
        return out, counts
    # back off from the word before, then from the pair before
    known = np.flatnonzero(left_count >= LEAST)
    distinct, back = np.unique(left[known], return_inverse=True)
    out[known] += word_backoffs(trie, distinct)[back]
    hit = np.flatnonzero(pair >= 0)
    if len(hit):
        out[hit] = restore(trie.of_pairs(pair[hit], 2, np.uint16(0)))
    context = previous(pair, first, -1)
    known = np.flatnonzero(context >= 0)
    if len(known) and trie.info["triple_files"]:
        distinct, back = np.unique(context[known], return_inverse=True)
        out[known] += pair_backoffs(trie, distinct)[back]
        both = known[place[known] >= 0]
        if len(both):
            found = trie.triples(context[both], place[both])
            hit = ~np.isnan(found)
            out[both[hit]] = found[hit]
    return out, counts


def word_backoffs(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """log10 back-off weights of words; 0 for those without successors."""
    out = np.zeros(len(ids))
    hot = trie.info["hot"]
    for p, rows in by_part(np.searchsorted(trie.starts, ids, "right") - 1):
        if trie.pair_starts[8 * p] < trie.pair_starts[8 * p + 1]:
            out[rows] = restore(trie.pair_file(8 * p)[3][ids[rows] - trie.starts[p]])
    for i in np.flatnonzero(np.isin(ids, np.fromiter(hot, np.int64, len(hot)))).tolist() if hot else ():
        total = trie.of_ids(ids[i : i + 1], "words", 1, np.uint64(0))[0]
        out[i] = math.log10(max(1 - hot[int(ids[i])] / int(total), 1e-9))
    return out


def fold(folds: int = FOLDS):
    """crc32 of the id as text; a null id is in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def score_documents(docs: DataFrame, folder: str, bits: int, info: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text."""

    def run(batches):
        trie = opened(folder, bits, info, "all")
        for batch in batches:
            for lo, hi, hashes, first in sequences(batch):
                if trie.total:
                    scores, counts = log_probabilities(trie, hashes, first)
                    base = trie.base(counts)
                else:
                    scores = base = np.zeros(len(hashes))
                    counts = np.zeros(len(hashes), np.int64)
                at = first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(scores, at))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op6_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every document.

    Nulls: a null text is the end token only; a null doc_id is scored and
    learned from.  Repeated rows count each time.  Without training documents
    scores are 0.  Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    folder, bits, info = fit(docs)
    scored = score_documents(docs, folder, bits, info)
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(info["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
