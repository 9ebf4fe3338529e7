"""Language of documents by a linear-chain conditional random field.

Every word of a text gets a language label; neighbouring words are tied by
learned transitions, so that a text that switches languages is labelled span
by span.  Word features are byte n-grams with word boundaries (a boundary
makes an n-gram an affix) and the word itself (a lexicon).  Training maximises
the conditional likelihood by forward-backward on a bounded sample of labelled
documents; a document's language is the label with the largest sum of word
posteriors over its whole text, its score that sum's share.

A text is one chain, whatever its length.  To decode many at once it is cut
into pieces: each piece's transfer matrix carries forward messages to the piece
after it and backward messages to the one before.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import bounded_batches, release, slices, table, text_buffer
from faultline.llm.words import mix

UNKNOWN = "und"
#: bound of the training sample: documents of each language, and words of each
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 300, 80
#: words of a piece of a chain
PIECE = 32
#: most languages, which bounds the model that every task gets (1 MB each)
MOST_LANGUAGES = 500
_SIZES = (1 << 15, 1 << 16, 1 << 16, 1 << 16)  # 2-, 3-, 4-grams, words
_BASE = np.cumsum((0,) + _SIZES)
_ZERO = int(_BASE[-1])  # the row of no feature
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def word_features(data: np.ndarray, offsets: np.ndarray):
    """Features of all words of a buffer of documents.

    Returns (n-gram feature ids by byte position, first position of each
    word's n-grams, lexicon feature of each word, first word of each
    document).  A position holds a 2-, a 3- and a 4-gram.
    """
    n_docs = len(offsets) - 1
    size = len(data) + n_docs + 1  # a boundary before each document and at the end
    at = np.arange(len(data)) + np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))
    text = np.full(size + 3, 32, np.uint8)
    text[at] = _LOWER[data]
    space = text == 32
    starts = np.flatnonzero(space[:size] & ~space[1 : size + 1])  # the boundary before each word
    b = text.astype(np.uint32)
    two = b[1 : size + 1] << 8
    two |= b[:size]
    three = b[2 : size + 2] << 16
    three |= two
    four = b[3 : size + 3] << 24
    four |= three
    s0, s1, s2 = space[:size], space[1 : size + 1], space[2 : size + 2]
    ids = np.empty((3, size), np.int32)
    for k, (code, none, bits) in enumerate(((two, s0 & s1, 15), (three, s1, 16), (four, s1 | s2, 16))):
        row = code * np.uint32(0x9E3779B1)
        row >>= np.uint32(32 - bits)
        row += np.uint32(_BASE[k])
        row[none] = _ZERO
        ids[k] = row
    # a word's hash comes from the sum of its squared 3-grams
    if len(starts):
        three[s1] = 0
        square = three.astype(np.uint64)
        square *= square
        lexicon = (mix(np.add.reduceat(square, starts)) >> np.uint64(48)).astype(np.int32) + int(_BASE[3])
    else:
        lexicon = np.zeros(0, np.int32)
    first = np.searchsorted(starts, offsets + np.arange(n_docs + 1))
    return ids, starts, lexicon, first


def _emissions(weights: np.ndarray, ids, starts, lexicon) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, weights.shape[1]))
    scores = np.take(weights, ids[0], axis=0)
    scores += np.take(weights, ids[1], axis=0)
    scores += np.take(weights, ids[2], axis=0)
    return np.add.reduceat(scores, starts, axis=0) + weights[lexicon]


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)) + scores.dtype.type(1e-30)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False, entry=None, after=None):
    """Posteriors [step, label, chain] of chains of emission scores in that
    layout, and with ``pairs`` also the summed posteriors of neighbouring
    labels.  What lies beyond a chain's length has no meaning.

    ``entry`` [label, chain] has messages to a chain's first word, already
    passed over a transition, ``after`` those to its last word from what
    follows; without them a chain begins and ends there.
    """
    steps, labels, chains = scores.shape
    e = potentials(scores)
    step = np.exp(transitions).astype(scores.dtype)
    alpha = np.empty_like(e)
    now = np.full((labels, chains), 1.0 / labels, scores.dtype) if entry is None else entry
    for t in range(steps):
        now = (now if t == 0 else step.T @ now) * e[t]
        now /= now.sum(axis=0)
        alpha[t] = now
    last = np.ones((labels, chains), scores.dtype) if after is None else after
    beta = last.copy()
    counts = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        onward = e[t] * beta
        if pairs and t:
            inside = lengths > t
            joint = alpha[t - 1][:, None, :] * step[:, :, None] * onward[None, :, :]
            counts += (joint / joint.sum(axis=(0, 1)))[:, :, inside].sum(axis=2)
        alpha[t] *= beta
        alpha[t] /= alpha[t].sum(axis=0)
        beta = step @ onward
        beta /= beta.sum(axis=0)
        outside = lengths <= t
        beta[:, outside] = last[:, outside]
    return (alpha, counts) if pairs else alpha


def transfers(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """[chain, label before, label at its end]: what a chain makes of forward
    messages, but for a factor."""
    steps, labels, chains = scores.shape
    e = potentials(scores).transpose(0, 2, 1)
    step = np.exp(transitions).astype(scores.dtype)
    out = step[None] * e[0][:, None, :]
    for t in range(1, steps):
        inside = lengths > t
        more = (out[inside] @ step) * e[t][inside][:, None, :]
        out[inside] = more / more.sum(axis=(1, 2), keepdims=True)
    return out


def messages(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``entry`` and ``after`` of every piece of longer chains.  ``place``
    numbers a chain's pieces from 0; pieces of a chain are neighbours."""
    labels, chains = scores.shape[1:]
    step = np.exp(transitions).astype(scores.dtype)
    entry, after = np.full((labels, chains), 1.0 / labels, scores.dtype), np.ones((labels, chains), scores.dtype)
    inner = np.flatnonzero((place > 0) | np.append(place[1:] > 0, False))
    if not len(inner):
        return entry, after
    moved = np.zeros((chains, labels, labels), scores.dtype)
    moved[inner] = transfers(scores[:, :, inner], lengths[inner], transitions)
    # the first piece of a chain isn't entered by a transition
    heads = inner[place[inner] == 0]
    now = forward_ends(scores[:, :, heads], lengths[heads], step)
    state = np.zeros((labels, chains), scores.dtype)
    state[:, heads] = now
    order = inner[np.argsort(place[inner], kind="stable")]
    cuts = np.searchsorted(place[order], np.arange(1, int(place.max()) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = order[lo:hi]
        entry[:, own] = step.T @ state[:, own - 1]
        passed = np.einsum("ic,cij->jc", state[:, own - 1], moved[own])
        state[:, own] = passed / passed.sum(axis=0)
    for lo, hi in zip(cuts[:-1][::-1], cuts[1:][::-1]):
        own = order[lo:hi]
        back = np.einsum("cij,jc->ic", moved[own], after[:, own])
        after[:, own - 1] = back / back.sum(axis=0)
    return entry, after


def forward_ends(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward messages at the ends of chains that begin there."""
    e = potentials(scores)
    now = e[0] / e[0].sum(axis=0)
    for t in range(1, len(e)):
        inside = lengths > t
        more = (step.T @ now[:, inside]) * e[t][:, inside]
        now[:, inside] = more / more.sum(axis=0)
    return now


def _chains(scores: np.ndarray, first: np.ndarray, length: int):
    """Cuts each document's words into chains: (padded scores, lengths,
    step and chain of each word)."""
    words = np.diff(first)
    per_doc = -(-words // length)
    chain0 = np.cumsum(per_doc) - per_doc
    place = np.arange(len(scores)) - np.repeat(first[:-1], words)
    row = np.repeat(chain0, words) + place // length
    place %= length
    total = int(per_doc.sum())
    lengths = np.bincount(row, minlength=total)
    padded = np.zeros((int(lengths.max()) if total else 0, scores.shape[1], total), scores.dtype)
    padded[place, :, row] = scores
    return padded, lengths, place, row


class Model:
    """Labels, feature weights and transitions.  Their size depends on the
    number of languages only."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def posteriors(self, data: np.ndarray, offsets: np.ndarray):
        """(posterior of each word, first word of each document)."""
        ids, starts, lexicon, first = word_features(data, offsets)
        scores = _emissions(self.weights, ids, starts, lexicon)
        padded, lengths, place, row = _chains(scores, first, PIECE)
        if not len(padded):
            return np.zeros((0, len(self.labels))), first
        pieces = -(-np.diff(first) // PIECE)
        number = np.arange(len(lengths)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        entry, after = messages(padded, lengths, self.transitions, number)
        return forward_backward(padded, lengths, self.transitions, entry=entry, after=after)[place, :, row], first

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each document's share of every language; 0 without words."""
        words, first = self.posteriors(data, offsets)
        sums = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(words, axis=0)))
        total = sums[first[1:]] - sums[first[:-1]]
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def train(texts: list[str], labels: list[str], rounds: int = 6, rate: float = 0.4, decay: float = 1e-5, seed: int = 5) -> Model:
    """Fits the field on labelled texts.

    Training chains are spans of one text or, for half of them, spans of
    several texts one after the other, so transitions are learned from
    switches as well.  AdaGrad on the conditional log-likelihood.
    """
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = len(names)
    weights, transitions = np.zeros((_ZERO + 1, k)), np.zeros((k, k))
    if k < 2:
        return Model(names, weights, transitions)
    spans: list[tuple[bytes, int]] = []
    for text, label in zip(texts, labels):
        words = text.encode().split()
        begin = int(rng.integers(0, max(len(words) - SAMPLE_WORDS, 0) + 1))
        words = words[begin : begin + SAMPLE_WORDS]
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 25))
            spans.append((b" ".join(words[at : at + n]), names.index(label)))
            at += n
    order = rng.permutation(len(spans))
    chains, at = [], 0
    while at < len(order):
        n = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
        chains.append([spans[i] for i in order[at : at + n]])
        at += n
    squares, square_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    for _ in range(rounds):
        rng.shuffle(chains)
        for lo in range(0, len(chains), 256):
            batch = chains[lo : lo + 256]
            data = np.frombuffer(b"".join(b" ".join(s for s, _ in c) for c in batch), np.uint8)
            offsets = np.cumsum([0] + [sum(len(s) for s, _ in c) + len(c) - 1 for c in batch])
            truth = np.concatenate([np.full(len(s.split()), y) for c in batch for s, y in c])
            ids, starts, lexicon, first = word_features(data, offsets)
            if not len(starts):
                continue
            padded, lengths, place, row = _chains(_emissions(weights, ids, starts, lexicon), first, 10**6)
            posterior, pairs = forward_backward(padded, lengths, transitions, pairs=True)
            gradient = -posterior[place, :, row]
            gradient[np.arange(len(truth)), truth] += 1
            seen = np.zeros((k, k))
            same = np.ones(len(truth), bool)
            same[first[:-1][np.diff(first) > 0]] = False
            follow = np.flatnonzero(same)
            np.add.at(seen, (truth[follow - 1], truth[follow]), 1)
            spread = np.repeat(gradient, np.diff(np.append(starts, ids.shape[1])), axis=0)
            step = np.empty_like(weights)
            used = ids[:, starts[0] :]
            for y in range(k):
                step[:, y] = np.bincount(used.ravel(), np.tile(spread[:, y], 3), _ZERO + 1)
                step[:, y] += np.bincount(lexicon, gradient[:, y], _ZERO + 1)
            step[_ZERO] = 0
            step -= decay * len(truth) * weights
            squares += step * step
            weights += rate * step / np.sqrt(squares)
            step_t = seen - pairs - decay * len(truth) * transitions
            square_t += step_t * step_t
            transitions += rate * step_t / np.sqrt(square_t)
    return Model(names, weights.astype(np.float32), transitions)


def fold(doc_id: str = "doc_id", folds: int = 4):
    """crc32 of the id as text; a null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def learn(docs: DataFrame, held_out: int = 2, folds: int = 4, documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Fits a model on at most ``documents`` texts of each language, chosen
    by a hash of id and text over all documents outside the held-out fold, and
    on at most SAMPLE_WORDS words of each, a run of them from a hashed place.
    Equal rows count once.  More than MOST_LANGUAGES languages are an error.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold("doc_id", folds), F.lit(-1)) != held_out))
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "lang", F.xxhash64("text")).alias("place"))
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # places first: the ranking moves no text.  A language is ranked in parts,
    # of whose first ones the first are chosen.
    chosen = labelled.select("lang", "place")
    for keys in (["lang", F.pmod("place", F.lit(64))], ["lang"]):
        ranks = Window.partitionBy(*keys).orderBy("place")
        chosen = chosen.withColumn("rank", F.dense_rank().over(ranks)).where(F.col("rank") <= (documents if keys == ["lang"] else max(documents // 8, 1))).drop("rank").distinct()
    places = [r[0] for r in chosen.select("place").collect()]  # bounded by documents x languages
    if not places:
        return Model([], np.zeros((_ZERO + 1, 0), np.float32), np.zeros((0, 0)))
    words = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    rows = labelled.where(F.col("place").isin(places)).select("place", "lang", words.alias("words"))
    begin = F.pmod(F.xxhash64(F.lit("begin"), "place"), F.greatest(F.size("words") - SAMPLE_WORDS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("place", "lang", F.array_join(F.slice("words", begin, SAMPLE_WORDS), " ").alias("text"))
    rows = sorted(rows.groupBy("place").agg(F.first("lang").alias("lang"), F.first("text").alias("text")).collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def label_documents(docs: DataFrame, model: Model, least_score: float | None = None, columns: bool = True) -> DataFrame:
    """Adds lang_pred and lang_score to every document, in place of input
    columns of these names.

    Nulls and texts without a letter give ``und`` with score 0; without a
    learned language so does every text.  Only the text is looked at, all of
    it.  Repeated rows each get the label, ties go to the language first in
    the alphabet, an empty table gives no rows.  With ``least_score``
    documents that are ``und`` or below it are left out, and no column is
    added or replaced.  With ``columns=False`` only doc_id is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))
    bounded_batches(docs.sparkSession)
    source = docs if columns else docs.select("doc_id", "text")
    keep = source.columns if least_score is not None else [c for c in source.columns if columns and c not in ("lang_pred", "lang_score")] or ["doc_id"]
    text_at = source.columns.index("text")
    picks = [source.columns.index(c) for c in keep]

    def run(batches):
        import pyarrow as pa

        field = Model(*shared.value)
        for whole in batches:
            ends = text_buffer(whole.column(text_at))[1]
            for lo, hi in slices(ends, 1 << 18):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(text_at)
                data, offsets = text_buffer(texts)
                known = np.array([t is not None and has_letter(t) for t in texts.to_pylist()], bool)
                if field.labels:
                    shares = field.predict(data, offsets)
                    best = shares.argmax(axis=1)
                    score = np.minimum(shares[np.arange(len(best)), best], 1.0)
                    known &= score > 0
                else:
                    best, score, known = np.zeros(len(known), int), np.zeros(len(known)), known & False
                score = np.where(known, score, 0.0)
                if least_score is not None:
                    part = pa.RecordBatch.from_arrays([batch.column(p) for p in picks], keep)
                    yield part.filter(pa.array(known & (score >= least_score)))
                    continue
                names = [field.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                yield pa.RecordBatch.from_arrays([batch.column(p) for p in picks] + [pa.array(names, pa.string()), pa.array(score)], keep + ["lang_pred", "lang_score"])
        release()

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, schema if least_score is not None else f"{schema}, lang_pred string, lang_score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    A null doc_id is in no fold.  Nulls, texts without letters, ties, repeated
    rows, long texts, empty tables and other columns are as
    ``label_documents`` and ``learn`` say.
    """
    docs = table(spark, sf_dir, "documents")
    labelled = label_documents(docs, learn(docs), columns=False)
    return labelled.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
