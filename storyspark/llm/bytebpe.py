"""Byte-level BPE through a sentencepiece model that is written from a rank vocabulary.

Each vocabulary entry becomes a piece (its bytes mapped to printable characters) with its negative rank
as score, so sentencepiece merges in rank order. Normalisation is the identity and no space is added
or escaped. Pre-tokens must not merge with each other: a user-defined piece, which never merges,
stands between them, so that a whole text is one call. Ids are decoded by the inverse byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

# Fixed values of sentencepiece's model format: kinds of pieces, and the BPE model type.
NORMAL, UNKNOWN, USER_DEFINED, BPE = 1, 2, 4, 2
#: Ids that the model has before the vocabulary's own: the unknown piece and the divider.
FIRST = 2
#: A byte that UTF-8 never has marks the divider between pre-tokens.
DIVIDER_BYTE, DIVIDER = 0xFF, "\ue000"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next above 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    by_rank = {int(r): base64.b64decode(t) for t, r in rows}
    return [by_rank[i] for i in range(len(by_rank))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a 32-bit float, or a whole number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model of the vocabulary."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))

    pieces = [piece("<unk>", 0.0, UNKNOWN), piece(DIVIDER, 0.0, USER_DEFINED)]
    pieces += [piece("".join(chars[b] for b in t), -float(i), NORMAL) for i, t in enumerate(vocabulary)]
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(24, 0) + _field(40, 0)
    minus = (1 << 64) - 1  # -1: no begin, end or padding piece
    trainer += _field(41, minus) + _field(42, minus) + _field(43, minus)
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, plain)


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self.pattern = regex.compile(pattern)
        self.divider = "\udcff"
        table = np.array([ord(c) for c in byte_characters()], np.uint16)
        table[DIVIDER_BYTE] = ord(DIVIDER)
        self.table = table
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = [b"", b""] + [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(FIRST, self.model.get_piece_size())]
        self.names = ["", ""] + [f"{i}," for i in range(self.model.get_piece_size() - FIRST)]
        # a pre-token that is itself an entry has that id, even where merges lead elsewhere
        whole = {t: i for i, t in enumerate(vocabulary)}
        self.apart = {t: i for t, i in whole.items() if self._pieces(t) != [i + FIRST]}

    def _pieces(self, data: bytes) -> list[int]:
        return self.model.encode(self.table[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le"))

    def pieces(self, text: str) -> list[int]:
        """Model ids of a text, dividers included."""
        tokens = self.pattern.findall(text)
        if not self.apart:
            return self._pieces(self.divider.join(tokens).encode("utf-8", "surrogateescape"))
        out: list[int] = []
        held: list[str] = []
        for t in tokens:
            if (i := self.apart.get(t.encode())) is None:
                held.append(t)
                continue
            out += self._pieces(self.divider.join(held).encode("utf-8", "surrogateescape")) + [i + FIRST]
            held = []
        return out + self._pieces(self.divider.join(held).encode("utf-8", "surrogateescape"))

    def encode(self, text: str) -> list[int]:
        return [i - FIRST for i in self.pieces(text) if i >= FIRST]

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i + FIRST] for i in ids])

    def digests(self, pieces: list[int]) -> tuple[int, str, str]:
        """Number of ids, hash of the decimal ids joined by commas, hash of the decoded bytes."""
        names, table = self.names, self.bytes
        said = "".join([names[i] for i in pieces])[:-1]
        decoded = b"".join([table[i] for i in pieces])
        count = len(pieces) - pieces.count(1) - pieces.count(0)
        return count, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process; the vocabulary file is there on every machine."""
    return Codec(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``(<id_col>, n_tokens, ids_sha256, decoded_sha256)`` and, ``with_ids``, the list ``ids``; one row
    for each input row, in which only the two named columns are read. A null text counts as empty;
    repeated and null ids are kept.
    """
    arrow_rows(docs.sparkSession, 500)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            pieces = [own.pieces(x or "") for x in batch.column(1).to_pylist()]
            found = [own.digests(p) for p in pieces]
            cols = [batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            if with_ids:
                cols.append(pa.array([[i - FIRST for i in p if i >= FIRST] for p in pieces], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = ", ids array<int>" if with_ids else ""
    out = rows.mapInArrow(told, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
    return out.withColumnRenamed("id", id_col)
