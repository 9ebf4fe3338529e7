import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import simple8b
from faultline.llm.token_files import op3_token_files, pack_shard, unpack_shard
from faultline.llm.tokens import encoder, tokenizer_path

from .conftest import DOCUMENT

ODD = [None, "", " \n\t", "It's THE-END, isn't it? <|endoftext|> <|EndOfText|>", "Éèê çà ñ ß ﬁ é İstanbul", "a b c\x1cd", "x" * 5000 + ".!", "日本 123 45,6 $%&", "word. Word, WORD! word?"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**60 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets) == values).all()


def test_blocks_decode_alone():
    values = np.random.default_rng(0).integers(0, 50000, 3 * simple8b.BLOCK + 17).astype(np.uint64)
    words, offsets = simple8b.encode(values)
    assert len(words) * 8 < len(values) * 3
    for lo, hi in ((0, 5), (simple8b.BLOCK - 3, 2 * simple8b.BLOCK + 9), (len(values) - 4, len(values))):
        assert (simple8b.decode(words, offsets, lo, hi) == values[lo:hi]).all()


def test_shard_round_trip():
    ids = [np.array(x, "<u4").tobytes() for x in ([1], [5, 70000, 1], [2**32 - 1, 1])]
    keys, ends, flat = unpack_shard(pack_shard([3, 4, 4], ids))
    assert keys.tolist() == [3, 4, 4] and ends.tolist() == [1, 4, 6] and flat.tobytes() == b"".join(ids)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZéÉñß'’.,! \n0<|>"), st.characters(codec="utf-8")), max_size=60))
def test_chunks_encode_as_the_whole_text(text):
    whole = encoder(tokenizer_path()).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(tokenizer_path()).encode(text.encode()), np.uint32).tolist() == whole


def test_query_against_the_library(spark, tables):
    texts = [*ODD, *ODD]
    rows = [(k // 2 * 3, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    got = op3_token_files(spark, tables(documents=(rows, DOCUMENT))).collect()
    library = Tokenizer.from_file(tokenizer_path())
    at, want = 0, []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    order = lambda r: (r[1],)
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(want, key=order)
    assert op3_token_files(spark, tables(documents=([], DOCUMENT))).count() == 0
