"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The vocabulary (token bytes and ranks) is written out as a sentencepiece BPE
model: every byte is mapped to a printable character, every token becomes one
piece scored by its negative rank, and the normaliser is the identity.  As
both algorithms merge, again and again, the leftmost pair whose union has the
lowest rank, the pieces of a pre-token are its tokens and a piece's id is the
rank.  Texts are cut into pre-tokens by the vocabulary's own pattern; decoding
is the inverse byte mapping.

Defined results: null and empty texts give an empty list; special tokens are
never produced, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder with the public vocabulary files; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pre-tokens kept with their ids in each worker; beyond it the table starts anew.
CACHE_ENTRIES = 1 << 18
#: Longer pre-tokens are encoded but not kept.
CACHE_CHARS = 64

#: Pre-token pattern of the byte_bpe vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


# ------------------------------------------------- model file (protocol buffers)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks of ``tokens``."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    unknown = len(tokens)
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2))
    trainer = _int_field(3, 2) + _int_field(4, unknown + 1)  # BPE, size
    trainer += _int_field(40, unknown) + b"".join(_int_field(k, -1) for k in (41, 42, 43))  # no bos, eos, pad
    normaliser = _bytes_field(1, b"identity") + _bytes_field(2, b"") + b"".join(_int_field(k, 0) for k in (3, 4, 5))
    out += _bytes_field(2, trainer) + _bytes_field(3, normaliser)
    return bytes(out)


class Encoder:
    """Encodes texts with a serialised model; keeps the ids of frequent pre-tokens."""

    def __init__(self, model: bytes, pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(pattern).findall
        chars = byte_characters()
        self._to_chars = {b: c for b, c in enumerate(chars)}
        self._to_bytes = {ord(c): b for b, c in enumerate(chars)}
        self._known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self._split(t) if t else [] for t in texts]
        known = self._known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list({p for ps in cut for p in ps if p not in known})
        long = {}
        if new:
            mapped = [p.encode().decode("latin-1").translate(self._to_chars) for p in new]
            for p, ids in zip(new, self._model.encode(mapped, num_threads=1), strict=True):
                (known if len(p) <= CACHE_CHARS else long)[p] = ids
        out = []
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                ids += known[p] if p in known else long[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self._model.id_to_piece(i) for i in ids)
        return bytes(self._to_bytes[ord(c)] for c in pieces).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, *, text: str, key: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids) for each row: the token ids of the text.

    ``vocabulary`` is the path of the rank file, read once by the driver; the
    model made from it (about 1 MB, bounded by the vocabulary) is broadcast.
    Another vocabulary than the default one needs its own ``pattern`` of
    pre-tokens.
    """
    if vocabulary is not None and pattern is None:
        raise ValueError("a vocabulary of one's own needs its pattern of pre-tokens")
    pattern = pattern or PATTERN
    path = vocabulary or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
    model = df.sparkSession.sparkContext.broadcast(serialise_model(load_ranks(path)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, pattern)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
