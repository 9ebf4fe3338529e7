
import numpy as np

import corpus_pipeline
from faultline.llm.tokens import encoder, tokenizer_path

from .conftest import DOCUMENT
from .test_language import WORDS, sample


def documents():
    langs = list(WORDS)
    rows = [(k, sample(langs[k % 3], k, 40), langs[k % 3], f"s{k % 4}", 0) for k in range(90)]
    rows += [(200 + k, rows[k][1], rows[k][2], "s0", 0) for k in range(10)]  # copies
    rows += [(300, None, "aa", "s1", 0), (301, "12 34", None, "s1", 0), (302, "", None, None, 0)]
    return rows


def test_stages_take_effect(spark, tables):
    folder = tables(documents=(documents(), DOCUMENT))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in documents()} - {300, 301, 302}
    once = corpus_pipeline.near_duplicate_groups(spark, kept, folder)
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == set(range(90))
    mixed = corpus_pipeline.mixed(spark, once, folder)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(range(90))
    # the last stage packs every id of what it gets
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    pieces = corpus_pipeline.packed(spark, mixed, folder).collect()
    total = sum(len(encoder(tokenizer_path()).encode(r["text"].encode())) // 4 + 1 for r in mixed.collect())
    assert sum(p["length"] for p in pieces) == total
    assert np.all([p["offset"] + p["length"] <= 2048 for p in pieces])


def test_run_and_empty_table(spark, tables):
    folder = tables(documents=(documents(), DOCUMENT))
    assert corpus_pipeline.run(spark, folder).count() > 30
    assert corpus_pipeline.run(spark, tables(documents=([], DOCUMENT))).count() == 0


def test_repeated_rows_leave_one(spark):
    text = sample("aa", 1, 50)
    docs = spark.createDataFrame([(1, text, "aa", "s", 0), (1, text, "aa", "s", 0), (2, text, "aa", "s", 0), (None, text, "aa", "s", 0)], DOCUMENT)
    kept = corpus_pipeline.near_duplicate_groups(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())[0] == (False, 1)
    assert kept.where("doc_id is not null").count() == 1


def test_near_copies_between_80_and_90_percent(spark):
    """The stage against brute force over runs of five words."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        text = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
        rows.append((len(rows), " ".join(text)))
        for edits in range(1, 7):
            own = list(text)
            for at in rng.choice(np.arange(10, 190, 10), edits, replace=False):
                own[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    low = list(range(len(rows)))
    between = 0
    for _ in rows:  # the lowest id spreads over links
        for i in range(len(rows)):
            for j in range(i // 7 * 7, i):
                share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                between += 0.8 <= share < 0.9
                if share >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
        if low == [low[k] for k in low]:
            break
    want = {k for k, at in enumerate(low) if k == at}
    assert between and 12 <= len(want) < len(rows)
    docs = spark.createDataFrame([(k, t, "aa", "s", 0) for k, t in rows], DOCUMENT)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()} == want


def test_repeated_ids_with_different_texts(spark):
    text = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    rows = [(1, text[0]), (2, text[0] + " more"), (2, text[1]), (2, text[1] + " more"), (2, text[2]), (3, text[3]), (3, text[3]), (4, text[2])]
    docs = spark.createDataFrame([(k, t, "aa", "s", 0) for k, t in rows], DOCUMENT)
    got = sorted((r["doc_id"], r["text"].removesuffix(" more")) for r in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect())
    assert got == [(1, text[0]), (2, text[1]), (2, text[2]), (3, text[3])]


def test_extra_columns_and_long_texts_go_through(spark):
    """Columns that operators use themselves are the caller's here."""
    long = " ".join(sample("aa", k, 50) for k in range(600))
    rows = [(k, sample("aa", k, 60), "aa", f"s{k % 2}") for k in range(30)] + [(50, long, "aa", "s0"), (51, long, "aa", "s0"), (52, long + " river", "aa", "s1")]
    names = ["lang_pred", "lang_score", "copy", "rate", "_mix_key", "key", "component", "place", "part", "length"]
    docs = spark.createDataFrame([(*r, *[f"{r[0]}{c}" for c in names]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert all(r[c] == f"{r['doc_id']}{c}" for r in docs.collect() for c in names), name
        if name == "near_duplicates":
            assert {r["doc_id"] for r in docs.collect() if r["doc_id"] >= 50} == {50}
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_plans_are_freed_on_the_way(spark, tables):
    """Between its phases the driver gives the heap of finished plans back."""
    docs = spark.read.parquet(tables(documents=(documents(), DOCUMENT)) + "/documents.parquet")

    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))

    before = collections()
    corpus_pipeline.near_duplicate_groups(spark, docs, "")
    assert collections() >= before + 3
