import itertools
import random
import re

from faultline.llm.filter_audit import FILTERS, audit_filters, mask_cells, op12_filter_audit, parity_sums


def failures(doc_id, text, docs):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    yield len(words) < 200
    yield 100 * len(set(words)) < 50 * len(words)
    yield 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
    yield bool(re.search("[#$%&*|]", text))
    yield doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(lang or "", i, {f for f, x in zip(FILTERS, failures(i, text, docs)) if x}) for i, text, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [(i, fails) for p, i, fails in rows if p == part]
        for order in itertools.permutations(FILTERS):
            gone = {k: min([order.index(f) for f in fails], default=9) for k, (_, fails) in enumerate(own)}
            for step, letter in enumerate(order):
                here = [own[k][0] for k, at in gone.items() if at == step]
                out[part, "".join(order), step + 1] = [
                    sum(at > step for at in gone.values()), len(here), sum(letter in own[k][1] and at < step for k, at in gone.items()),
                    sum(fails == {letter} for _, fails in own), sum(i in good for i in here), sum(i in toxic for i in here),
                ]
    shapley = {}
    for (part, order, step), row in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + row[1]
    return {(*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def test_cells_come_back_from_parity_sums(spark):
    rng = random.Random(1)
    masks = [(rng.choice("ab"), rng.randrange(32), rng.randrange(1, 2**55)) for _ in range(60)]
    frame = spark.createDataFrame(masks, "part string, mask int, n long")
    got = {(r.part, r.mask): r.n for r in mask_cells(parity_sums(frame, 5, ["part"]), 5).collect()}
    want = {(p, m): sum(n for q, k, n in masks if (q, k) == (p, m)) for p in "ab" for m in range(32)}
    assert got == want


def test_against_all_orders(spark, tables):
    rng = random.Random(2)
    kinds = [
        lambda: " ".join(f"w{k}" for k in range(rng.choice([199, 200, 250]))),
        lambda: " ".join(rng.choice("ab") for _ in range(rng.choice([100, 300]))),
        lambda: "ABC " * rng.randrange(1, 5) + "x" * 300,
        lambda: "a | b\x0bc d" + " w" * rng.choice([5, 400]),
        lambda: rng.choice(["", None, "same text", "\t \n", "É" * 30 + "ÀÖ", "0" * 20_000]),
    ]
    docs = [(i, rng.choice(kinds)(), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(1, docs[1][1], "en"), (1, "other", "de"), (5, "same text", "en"), (5, "same text", "en"), (None, "same text", "en"), (None, None, None), (-3, "same text", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    sf = tables(
        documents=([(*r, 3, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string"),
        labels=([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string"),
    )
    got = op12_filter_audit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, labels)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert not audit_filters(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count()
