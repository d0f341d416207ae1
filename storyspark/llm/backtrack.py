"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A tokenizer file with word ends is read as data: its vocabulary and merges. A pre-token becomes a row of
symbols, one for each byte, the last of them another symbol than the same byte inside a word; so no
token reaches over a word's end and the words of a batch are encoded as one row of symbols. An
Aho-Corasick automaton of the reversed tokens goes over that row from its end and finds the longest
token that starts at each place. A token may stand after another only if merging the two would give these two
again; that is looked up in a table of pairs. Where a longest token doesn't fit, its next shorter
prefix is tried, and where none fits the token before it is taken back. The result is the one row of
tokens in which all neighbours fit, which is what the merges make, in time linear in the length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bytebpe import byte_characters
from .common import arrow_rows, slices

#: Pieces that a worker keeps and the longest of them; known pairs; bytes of text that are encoded side by side.
KEPT, LONGEST, PAIRS, SLICE_BYTES = 800_000, 64, 2_000_000, 8 << 20
#: What white space is for the pattern; Python's split() knows four separators more.
_SPACES = regex.compile(r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NOT_SPACES = regex.compile(r"[\x1c-\x1f]")


class Encoder:
    """Vocabulary, pairs and automaton of one tokenizer file.

    The file must hold byte-level BPE with a word-end suffix whose merges are in the order of their
    tokens' ids, behind NFC, white space and lower-case normalisation and one splitting pattern; any other raises.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps, cut = file["model"], file["normalizer"]["normalizers"], file["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in steps] + [s["type"] for s in cut] + [cut[0].get("behavior"), cut[0].get("invert"), cut[1].get("add_prefix_space")]
        suffix = model["end_of_word_suffix"]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", "Removed", True, False] or not suffix or model["continuing_subword_prefix"] or file["decoder"]:
            raise ValueError(f"not a tokenizer of the kind that is read here: {path}")
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(regex.escape(t) for t in longest_first)) if longest_first else None
        vocabulary: dict[str, int] = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and token != suffix
            row = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, row[:-1])) + chr(row[-1] + 256 * ends)

        rows = {i: symbols(t) for t, i in vocabulary.items()}
        n = max([*rows, *self.special.values()]) + 1
        self.size = [len(rows.get(i, "")) for i in range(n)]
        self.closes = [bool(rows.get(i)) and ord(rows[i][-1]) >= 256 for i in range(n)]
        # how each token is made, and what a pair makes; single symbols are made by nothing
        self.left, self.right, self.made = [-1] * n, [-1] * n, {}
        last = -1
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if z <= max(last, x, y):
                raise ValueError("merges must be in the order of their tokens")
            last = z
            self.left[z], self.right[z], self.made[x * n + y] = x, y, z
        self.n, self.kind = n, "<u2" if n <= 1 << 16 else "<u4"
        self.pairs: dict[int, bool] = {}
        # a token whose two parts don't fit together, once its own merge is left out, is never the outcome of merges
        sound: dict[int, str] = {}
        for i, r in sorted(rows.items()):
            if self.left[i] < 0 or (self.left[i] in sound and self.right[i] in sound and self._fits(self.left[i], self.right[i], i)):
                sound[i] = r
        ids = {r: i for i, r in sound.items()}
        self.shorter = [-1] * n
        for r, i in ids.items():
            self.shorter[i] = next((ids[r[:k]] for k in range(len(r) - 1, 0, -1) if r[:k] in ids), -1)
        automaton = ahocorasick.Automaton()
        for r, i in ids.items():
            automaton.add_word(r[::-1], i)
        automaton.make_automaton()
        self.automaton = automaton
        # decoding and printing: all entries end to end, each with the blank behind it, and where each begins
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.names = _offsets([names.get(i, "").encode() + b" " for i in range(n)])
        self.digits = _offsets([b"%d " % i for i in range(n)])
        self.kept: dict[str | int, bytes] = {i: np.array([i], self.kind).tobytes() for i in self.special.values()}

    def _fits(self, a: int, b: int, limit: int) -> bool:
        """Whether nothing merges across the border of ``a`` and ``b`` before the merge ``limit``.

        Undoes the later of the two tokens' last merges again and again: the pieces at the border stood
        side by side until then. Of equal merges the left one comes first, so that a merge across the
        border wins over the same merge in ``b``, and loses against it in ``a``.
        """
        left, right, made, n = self.left, self.right, self.made, self.n
        while True:
            if made.get(a * n + b, limit) < limit:
                return False
            in_a, in_b = left[a] >= 0, left[b] >= 0
            if in_a and (a > b or not in_b):
                limit, a = min(limit, a), right[a]
            elif in_b:
                limit, b = min(limit, b + 1), left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """The table of pairs; filled as pairs are met."""
        key = a * self.n + b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(a, b, self.n)
        return known

    def longest(self, row: np.ndarray) -> list[int]:
        """The longest token that starts at each place of a row of symbols."""
        backwards = row[::-1].astype("<u2").tobytes().decode("utf-16-le")
        found = np.fromiter(chain.from_iterable(self.automaton.iter(backwards)), np.int64)
        ends, ids = found[0::2], found[1::2]
        first = np.flatnonzero(np.diff(ends, prepend=-1))  # at each place the longest comes first
        return ids[first][::-1].tolist()

    def encode_words(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Ids of pre-tokens, none of them empty, end to end; and at which id each pre-token ends."""
        out: list[int] = []
        ends: list[int] = []
        if not words:
            return out, ends
        row = np.frombuffer(b"".join(words), np.uint8).astype(np.uint16)
        row[np.cumsum([len(w) for w in words]) - 1] += 256
        longest = self.longest(row)
        size, closes, shorter, pairs, n, fits = self.size, self.closes, self.shorter, self.pairs, self.n, self.fits
        dead: set[int] = set()  # places of this word from which no way leads on
        at, token, before, total = 0, longest[0], -1, len(longest)
        while True:
            end = at + size[token]
            if before < 0:
                good = end not in dead
            else:
                key = before * n + token
                good = end not in dead and (pairs[key] if key in pairs else fits(before, token))
            if good:
                out.append(token)
                at = end
                if closes[token]:
                    ends.append(len(out))
                    if at == total:
                        return out, ends
                    before = -1
                    dead.clear()
                else:
                    before = token
                token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # no token fits here, so the one before leads nowhere
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                before = out[-1] if len(out) > (ends[-1] if ends else 0) else -1

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final form: signs are lowered one by one

    def _pieces(self, text: str) -> list[str]:
        text = self.normalised(text)
        return [p for p in _SPACES.split(text) if p] if _NOT_SPACES.search(text) else text.split()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts, as 16-bit or, for large vocabularies, 32-bit numbers."""
        kind = self.kind
        parts: list[list] = []
        for text in texts:
            text, own, begin = text or "", [], 0
            for hit in self.specials.finditer(text) if self.specials and "<" in text else ():
                own += [*self._pieces(text[begin : hit.start()]), self.special[hit.group()]]
                begin = hit.end()
            parts.append(own + self._pieces(text[begin:]) if begin else own + self._pieces(text))
        kept = self.kept
        new = list(filterfalse(kept.__contains__, set().union(*parts)))
        if len(kept) + len(new) > KEPT:
            kept.clear()
            kept.update((i, np.array([i], kind).tobytes()) for i in self.special.values())
            new = list(filterfalse(kept.__contains__, set().union(*parts)))
        cut = [self.pattern.findall(p) for p in new]
        ids, ends = self.encode_words([w.encode() for ws in cut for w in ws])
        raw, wide = np.array(ids, kind).tobytes(), np.dtype(kind).itemsize
        past = np.concatenate([[0], wide * np.array(ends, np.int64)])[np.cumsum([0, *map(len, cut)])].tolist()
        kept.update(zip(new, (raw[a:b] for a, b in pairwise(past)), strict=True))
        out = [np.frombuffer(b"".join(map(kept.__getitem__, own)), kind) for own in parts]
        for p in new:
            if len(p) > LONGEST:
                del kept[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Entries joined by one blank, in UTF-8."""
        return _rendered(self.names, ids)[:-1]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, hash of the decimal ids joined by one blank, hash of the decoded text."""
        said = memoryview(_rendered(self.digits, ids))[:-1]
        return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(self.decode_bytes(ids)).hexdigest()


def _offsets(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all entries, where each begins and how long it is."""
    sizes = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(sizes) - sizes, sizes


def _rendered(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The entries of ids end to end, some 100,000 ids at a time."""
    data, begin, sizes = table
    out = []
    for k in range(0, len(ids), 100_000):
        own = ids[k : k + 100_000]
        many = sizes[own]
        past = np.cumsum(many)
        out.append(data[np.repeat(begin[own] - past + many, many) + np.arange(past[-1])].tobytes())
    return out[0] if len(out) == 1 else b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; the tokenizer file is there on every machine."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``(<id_col>, n_tokens, ids_sha256, decoded_sha256)`` and, ``with_ids``, the list ``ids``; one row
    for each input row, in which only the two named columns are read. A null text counts as empty and has no ids;
    repeated and null ids are kept. Special tokens that stand in a text get their ids, as in the
    library; none is added. Memory is bounded by the largest single text and ``SLICE_BYTES``.
    """
    arrow_rows(docs.sparkSession, 2000)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids = own.encode_all(batch.column(1).to_pylist())
            found = [own.digests(i) for i in ids]
            cols = [batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = ", ids array<int>" if with_ids else ""
    out = rows.mapInArrow(told, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
    return out.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add ``text_col``, the decoded text of a list of ids; null for null, empty for none. Ids that are null or not
    in the vocabulary raise an error. A column of that name is replaced."""

    kind = StructType([*rows.drop(text_col).schema.fields, StructField(text_col, StringType())])
    at = rows.drop(text_col).columns.index(ids_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = pa.array([None if x is None else own.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], kind.names)

    return rows.drop(text_col).mapInArrow(told, kind)
