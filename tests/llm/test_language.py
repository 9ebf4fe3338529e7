import zlib

import numpy as np

from faultline.llm.language import PIECE, Model, _chains, forward_backward, label_documents, learn, messages, op8_language, train

from .conftest import DOCUMENT

WORDS = {"aa": "the of and that with from this house river".split(), "bb": "der die und nicht mit von haus fluss über".split(), "cc": "que los una casa río para señor año".split()}


def sample(lang, seed, n=30):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, steps = rng.normal(size=(4, 3, 2)), rng.normal(size=(3, 3))
    lengths = np.array([4, 3])
    got = forward_backward(scores, lengths, steps)
    for c, n in enumerate(lengths):
        total, marginal = 0.0, np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[t, path[t], c] for t in range(n)) + sum(steps[path[t - 1], path[t]] for t in range(1, n)))
            total += w
            for t in range(n):
                marginal[t, path[t]] += w
        assert np.allclose(got[:n, :, c], marginal / total, atol=1e-6)


def test_held_out_accuracy_and_odd_rows(spark, tables):
    langs = list(WORDS)
    rows = [(k, sample(langs[k % 3], k), langs[k % 3], "s", 0) for k in range(240)]
    odd = [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 !? 456", "aa", "s", 0), (None, sample("bb", 9), None, None, None), (1003, "über " * 20000, "bb", "s", 0)]
    got = {r["doc_id"]: r for r in op8_language(spark, tables(documents=(rows + odd, DOCUMENT))).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[r[0]]["held_out"] for r in held)
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == "bb" and got[1003]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_switching_text_is_labelled_by_span():
    texts = [sample(x, k) for k in range(60) for x in WORDS]
    model = train(texts, [x for _ in range(60) for x in WORDS])
    data = f"{sample('aa', 901, 12)} {sample('cc', 902, 12)}".encode()
    words, _ = model.posteriors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    best = [model.labels[i] for i in words.argmax(axis=1)]
    assert best.count("aa") >= 11 and best[:10].count("aa") >= 9 and best[-10:].count("cc") >= 9


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "hello there", None, "s", 0)], DOCUMENT)
    assert label_documents(docs, learn(docs)).first()["lang_pred"] == "und"
    assert label_documents(docs.limit(0), learn(docs)).count() == 0
    assert label_documents(docs.withColumn("lang_pred", docs["text"]), Model([], np.zeros((1, 0)), np.zeros((0, 0))), least_score=0.1).columns == [*docs.columns, "lang_pred"]


def test_pieces_are_one_chain():
    """Messages over pieces give what one pass over whole chains gives."""
    rng = np.random.default_rng(2)
    words = np.array([1, 40, 0, 300, 32, 64, 65])
    first = np.cumsum([0, *words])
    scores, steps = rng.normal(size=(first[-1], 3)) * 2, rng.normal(size=(3, 3))
    whole, lengths, place, row = _chains(scores, first, 10**6)
    want = forward_backward(whole, lengths, steps)[place, :, row]
    cut, lengths, place, row = _chains(scores, first, PIECE)
    pieces = -(-words // PIECE)
    number = np.concatenate([np.arange(n) for n in pieces])
    entry, after = messages(cut, lengths, steps, number)
    got = forward_backward(cut, lengths, steps, entry=entry, after=after)[place, :, row]
    assert np.allclose(got, want, atol=1e-9)


def mixed(x):
    mask = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def plain_features(word):
    """Feature numbers of a word, byte by byte."""
    sizes, base = (1 << 15, 1 << 16, 1 << 16), (0, 1 << 15, (1 << 15) + (1 << 16))
    padded, out, total = b" " + word + b" ", [], 0
    for n, size, begin in zip((2, 3, 4), sizes, base):
        for k in range(len(padded) - n + 1):
            code = int.from_bytes(padded[k : k + n], "little")
            out.append(begin + ((code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - size.bit_length() + 1)))
            total += code * code if n == 3 else 0
    return out, (1 << 15) + (2 << 16) + (mixed(total & (1 << 64) - 1) >> 48)


def test_query_equals_plain_inference(spark, tables):
    """Emissions, messages, sums and labels again, word by word."""
    langs = list(WORDS)
    rows = [(k, sample(langs[k % 3], k, 5 + k % 90), langs[k % 3], "s", 0) for k in range(90)]
    rows += [(200 + k, sample("aa", k, 40) + " \n" + sample("cc", k, 35) + " Über a I x1", None, "s", 0) for k in range(10)]
    folder = tables(documents=([(*r, "bb") for r in rows], DOCUMENT + ", lang_pred string"))
    model = learn(spark.read.parquet(f"{folder}/documents.parquet"))
    step = np.exp(model.transitions)
    got = {r["doc_id"]: r for r in op8_language(spark, folder).collect()}
    for doc_id, text, *_ in rows:
        e = []
        for word in text.encode().lower().split():
            grams, lexicon = plain_features(word)
            e.append(np.exp(sum((model.weights[g].astype(float) for g in grams), model.weights[lexicon].astype(float))))
        forward, backward = [e[0]], [np.ones(len(step))]
        for x in e[1:]:
            now = (forward[-1] @ step) * x
            forward.append(now / now.sum())
        for x in e[:0:-1]:
            now = step @ (x * backward[-1])
            backward.append(now / now.sum())
        shares = sum(p / p.sum() for p in (f * b for f, b in zip(forward, backward[::-1]))) / len(e)
        assert got[doc_id]["lang_pred"] == model.labels[int(shares.argmax())]
        assert abs(got[doc_id]["score"] - shares.max()) < 1e-4


def test_sample_is_bounded_and_never_empty(spark):
    rows = [(k % 7, sample("aa", k % 11, 5000), "aa", "s", 0) for k in range(100)] + [(k, sample("bb", k), "bb", "s", 0) for k in range(50)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    assert learn(docs, documents=4).labels == ["aa", "bb"]
    assert learn(docs, documents=1).labels == ["aa", "bb"]
    kept = label_documents(docs.withColumn("lang_pred", docs["text"]), learn(docs), least_score=0.1)
    assert kept.where("lang_pred = text").count() == len(rows)
