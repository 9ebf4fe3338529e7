import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm.packing import SEQUENCE, op5_packing, pack_documents, pack_histogram, sequences, slots
from faultline.llm.tokens import encoder, tokenizer_path

from .conftest import DOCUMENT


@settings(deadline=None, max_examples=80)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=20))
def test_patterns_place_every_piece_once(counts):
    patterns = pack_histogram(counts, 64)
    placed = {}
    for count, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == {n: c for n, c in counts.items() if c}
    rows = slots(patterns)
    assert len({(n, r) for n, r, _, _ in rows.tolist()}) == len(rows)


def test_little_padding_on_many_lengths():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 20000), minlength=2049)
    total = int((counts * np.arange(2049)).sum())
    n = sum(c for c, _ in pack_histogram({i: int(c) for i, c in enumerate(counts) if i}))
    assert n * 2048 < 1.01 * total


def test_query_against_brute_force(spark, tables):
    texts = [None, "", "word " * 5000, "a b c", "a b c", "x " * 2047, "y " * 2048, *(f"doc {k} " * (k % 90) for k in range(300))]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(3, "a b c", "en", "s", 0), (None, "nobody", None, None, None)]
    folder = tables(documents=(rows, DOCUMENT))
    got = op5_packing(spark, folder).collect()
    encode = encoder(tokenizer_path()).encode
    want = sorted((k is None, k or 0, start, len(ids[4 * start : 4 * (start + SEQUENCE)]) // 4, zlib.crc32(ids[4 * start : 4 * (start + SEQUENCE)]), len(ids) // 4) for k, t, *_ in rows for ids in [encode((t or "").encode()) + b"\1\0\0\0"] for start in range(0, len(ids) // 4, SEQUENCE))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    assert op5_packing(spark, tables(documents=([], DOCUMENT))).count() == 0


def test_sequences_hold_the_ids(spark, tables):
    docs = spark.createDataFrame([(k, f"some words {k} " * k, "en", "s", 0) for k in range(1, 40)], DOCUMENT)
    rows = sequences(pack_documents(docs, sequence=256, with_ids=True), 256).collect()
    total = sum(len(encoder(tokenizer_path()).encode(f"some words {k} ".encode() * k)) // 4 + 1 for k in range(1, 40))
    assert sum(r["n_ids"] for r in rows) == total
    assert all(len(r["ids"]) == 256 or r["n_ids"] & (r["n_ids"] - 1) == 0 for r in rows)


def test_extra_columns_are_ignored(spark, tables):
    rows = [(k, f"text {k} " * k, k, "x") for k in range(40)]
    folder = tables(documents=(rows, "doc_id long, text string, length long, sequence_id string"))
    got = op5_packing(spark, folder)
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and got.count() == 40
