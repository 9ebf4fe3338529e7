"""Token ids of whole texts with a public tokenizer.

The tokenizer drops white space and no piece of it spans white space, so a
text's ids are the ids of its whitespace-delimited chunks one after the other.
Chunks repeat, so each Python worker remembers their ids, up to a bound.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame

from faultline.llm.shared import bounded_batches, release

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 1

#: lower-case Latin letters that Unicode normalisation leaves alone, then
#: ASCII marks: the pre-tokenizer cuts such a chunk into these two pieces
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")
_ASCII = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]*)\Z")
MOST_MARKS = 10_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ChunkEncoder(dict):
    """Maps a chunk (lower-case ASCII bytes) to its ids as uint32 bytes.

    ``path`` names a tokenizers JSON file whose normaliser lower-cases.  Runs
    of letters are remembered when first met, chunks of a run and marks when
    the run is met again.  At most ``limit`` of both are kept; then they start
    anew.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.limit = limit
        self.symbols = _byte_symbols()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {b"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _mark(self, mark: bytes) -> bytes:
        """Ids of a run of marks."""
        if len(self.marks) >= MOST_MARKS:
            self.marks = {b"": b""}
        ids = self.marks[mark] = self._whole(mark.decode())
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        plain = _ASCII.match(chunk)
        if plain:
            run, mark = plain.groups()
        else:
            plain = _PLAIN.match(chunk.decode().lower())
            if not plain:
                ids = self[chunk] = self._whole(chunk.decode())
                return ids
            run, mark = plain[1].encode(), plain[2].encode()
        known = self.get(run)
        if known is None:
            text = run.decode() if run.isascii() else "".join(map(self.symbols.__getitem__, run))
            known = self[run] = array("I", [t.id for t in self.tokenize(text)]).tobytes()
            return known + (self.marks.get(mark) or self._mark(mark)) if mark else known
        if mark:
            known += self.marks.get(mark) or self._mark(mark)
        self[chunk] = known
        return known

    def encode(self, text: bytes) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        if any(s in text.lower() for s in self.special):
            # such strings are special in their exact spelling only
            return self._whole(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def document_ids(batches, path: str, end_id: int = END_ID):
    """Yields (arrow batch, list of each text's ids and end id as bytes).

    Null texts count as empty.  The batch keeps its other columns.
    """
    encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for lo in range(0, batch.num_rows, 256):
            part = texts.slice(lo, 256).cast("binary").to_pylist()
            yield batch.slice(lo, 256), [encode(t or b"") + end for t in part]
    # a worker lives longer than its task
    encoder(path).clear()
    release()


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids array<int>) of every document, end id included."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, ids in document_ids(batches, path, end_id):
            arrays = pa.array([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), arrays], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
