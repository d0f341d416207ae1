"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

Each id is coded against a mix of three predictions: the id that last followed the same two ids, the
one that last followed the same id (each weighted by how often predictions of its kind have held), and a
distribution of single ids. The last has adaptive counts of the ids' classes (256 ids each), summed up
anew every ``_EPOCH`` ids, and in each class the shares that the file's header lists. All state starts anew in
every block, so the blocks of a file are coded side by side, one array operation for all of them at each step.

File: ``MAGIC``; the header's length (uint32) and the header as JSON; the shares of the ids in their
classes (uint16), compressed; the tables of document ids (int64), null marks (uint8) and lengths (uint32),
compressed; then the blocks. The header lists for each block its ids, its bytes and the CRC-32 of its ids.
All numbers are little-endian. Ids are below 65,536.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_rows, fresh_dir, slices, written
from .files import created, opened

MAGIC = b"IDMIX002"
END = 1
#: Ids are below this.
MOST_IDS = 1 << 16
#: Ids in a block at most and at least, and blocks that are coded side by side.
BLOCK, LEAST_BLOCK, LANES = 8192, 512, 1024
#: Ids in a file.
FILE_IDS = BLOCK * LANES

_BITS = 32  # of the coder's total
_UNIT, _TOP, _BOTTOM = np.uint64(16), np.uint64(1 << 48), np.uint64(1 << 32)
_CLASS = 256  # ids in a class
_SCALE = 12  # bits of the total of classes, and of the shares in a class
_STEP = 32  # what a class's count grows by when one of its ids occurs
_EPOCH = 512  # steps after which the counts are summed up anew
_SLOTS1, _SLOTS2, _STATES = 4096, 8192, 8
_SURE = 3840  # of 4096: what a prediction's share rises to


def shares_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a file's ids: weight of each class (512 in all, 1 at least), and by id its share of 4096 in its class.

    An id that occurs has a share of 1 at least, one that does not has none, in a class that occurs.
    """
    n = int(ids.max()) // _CLASS + 1 if len(ids) else 1
    counts = np.bincount(ids, minlength=n * _CLASS).reshape(n, _CLASS)
    totals = counts.sum(axis=1, keepdims=True)
    given = (counts > 0).sum(axis=1, keepdims=True)
    shares = counts * ((1 << _SCALE) - given) // np.maximum(totals, 1) + (counts > 0)
    shares[np.arange(n), counts.argmax(axis=1)] += (1 << _SCALE) - shares.sum(axis=1)  # what rounding left
    return np.maximum(totals[:, 0] * 512 // max(len(ids), 1), 1), shares.ravel()


class Model:
    """The predictions of ``lanes`` blocks at one step; tables are flat, a lane's part after the other's."""

    def __init__(self, lanes: int, weights: np.ndarray, shares: np.ndarray, inverse: bool) -> None:
        n, lane = len(weights), np.arange(lanes)
        self.lanes, self.classes, self.inverse = lanes, n, inverse
        self.at_class, self.at_count, self.at_want = lane * (n + 1), lane * n, lane << _SCALE
        self.at_slot = np.stack([lane * (_SLOTS1 + _SLOTS2), lane * (_SLOTS1 + _SLOTS2) + _SLOTS1])
        self.at_trust = np.stack([lane * 2 * _STATES, (lane * 2 + 1) * _STATES])
        self.counts = np.tile(weights.astype(np.int64), (lanes, 1))
        shares = shares.astype(np.int64).reshape(n, _CLASS)
        self.inner = np.concatenate([np.zeros((n, 1), np.int64), shares.cumsum(axis=1)], axis=1).ravel()  # at id + class
        if inverse:
            self.inner_of = np.repeat(np.tile(np.arange(_CLASS, dtype=np.uint8), n), shares.ravel())
        self.cells = np.zeros(lanes * (_SLOTS1 + _SLOTS2), np.int32)  # id and state
        self.trust = np.full(lanes * 2 * _STATES, 512, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.seen: list[np.ndarray] = []
        self.refresh(lanes)

    def refresh(self, m: int) -> None:
        """Sum up the counts of the first ``m`` lanes, with what was seen since."""
        n = self.classes
        if self.seen:
            at = np.concatenate([self.at_count[: len(x)] + (x >> 8) for x in self.seen])
            self.counts += np.bincount(at, minlength=self.lanes * n).reshape(self.lanes, n) * _STEP
            self.seen = []
        sums = np.zeros((self.lanes, n + 1), np.int64)
        np.cumsum(self.counts, axis=1, out=sums[:, 1:])
        sums = sums * ((1 << _SCALE) - n) // sums[:, -1:] + np.arange(n + 1)  # every class has 1 at least
        self.sums = sums.ravel()
        if self.inverse:
            step = np.zeros((m, 1 << _SCALE), np.uint8)
            step[np.arange(m)[:, None], sums[:m, 1:-1]] = 1
            self.class_of = np.cumsum(step, axis=1, dtype=np.uint8).ravel()

    def predict(self, m: int) -> None:
        """Sets what the first ``m`` lanes expect: ids guessed by order 1 and 2 with their shares, and the rest's share."""
        if len(self.seen) == _EPOCH:
            self.refresh(m)
        mixed = self.last[:m] * 40503
        self.slots = np.stack([(mixed & 0xFFFF) >> 4, (mixed + self.before[:m] * 30011 & 0xFFFF) >> 3])
        self.slots += self.at_slot[:, :m]
        found = self.cells.take(self.slots)
        self.guess, self.state = found >> 3, found & 7
        self.places = self.state + self.at_trust[:, :m]
        self.odds = self.trust.take(self.places)
        two = self.odds[1] << (_BITS - 12)
        rest = (1 << _BITS) - two
        one = rest * self.odds[0] >> 12
        self.base = rest - one
        self.apart = self.guess[0] != self.guess[1]
        self.given = np.stack([one * self.apart, two + one * ~self.apart])

    def single(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size that rows of ids have in the distribution of single ids."""
        kind = ids >> 8
        at = kind + self.at_class[:m]
        low, high = self.sums.take(at) * self.base >> _SCALE, self.sums.take(at + 1) * self.base >> _SCALE
        high -= low
        at = ids + kind
        start = (self.inner.take(at) * high >> _SCALE) + low
        return start, (self.inner.take(at + 1) * high >> _SCALE) + low - start

    def interval(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' intervals: the guessed ids come first, order 2 before order 1."""
        starts, sizes = self.single(np.concatenate([self.guess, ids[None]]), m)
        own = sizes[:2] * np.stack([self.apart, np.ones(m, bool)])
        whole = self.given + own
        start = starts[2] + whole[0] + whole[1] - (own * (self.guess < ids)).sum(axis=0)
        size = sizes[2]
        self.hit = self.guess == ids
        start = np.where(self.hit[1], 0, np.where(self.hit[0], whole[1], start))
        return start, np.where(self.hit[1], whole[1], np.where(self.hit[0], whole[0], size))

    def find(self, target: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the targets, with start and size of these."""
        starts, sizes = self.single(self.guess, m)
        own = sizes * np.stack([self.apart, np.ones(m, bool)])
        whole = self.given + own
        front = whole[0] + whole[1]
        second = target < whole[1]
        ids = np.where(second, self.guess[1], self.guess[0]).astype(np.int64)
        start, size = np.where(second, 0, whole[1]), np.where(second, whole[1], whole[0])
        if (at := np.flatnonzero(target >= front)).size:
            guess, own, starts = self.guess[:, at], own[:, at], starts[:, at]
            left = target[at] - front[at]
            first = guess[0] <= guess[1]
            for low, width in ((np.where(first, *starts), np.where(first, *own)), (np.where(first, *starts[::-1]), np.where(first, *own[::-1]))):
                left += width * (left >= low)  # put back what the guesses, the smaller first, took to the front
            base = self.base[at]
            kind = self.class_of.take(self.at_want[at] + (((left + 1 << _SCALE) - 1) // base)).astype(np.int64)
            row = self.at_class[at] + kind
            low = self.sums.take(row) * base >> _SCALE
            width = (self.sums.take(row + 1) * base >> _SCALE) - low
            found = self.inner_of.take((kind << _SCALE) + (((left - low + 1 << _SCALE) - 1) // width)) + (kind << 8)
            row = found + kind
            begin = (self.inner.take(row) * width >> _SCALE) + low
            ids[at] = found
            size[at] = (self.inner.take(row + 1) * width >> _SCALE) + low - begin
            start[at] = begin + front[at] - (own * (guess < found)).sum(axis=0)
        self.hit = self.guess == ids
        return ids, start, size

    def update(self, ids: np.ndarray, m: int) -> None:
        self.trust[self.places] = self.odds + ((self.hit * _SURE - self.odds) >> 5)
        self.cells[self.slots] = ((self.state + (self.state < _STATES - 1)) * self.hit) | (ids << 3)
        self.seen.append(ids)
        self.before[:m] = self.last[:m]
        self.last[:m] = ids


def _narrow(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lanes whose leading unit is settled; the size of some is cut so that it settles."""
    settled = (low ^ (low + size)) < _TOP
    tight = ~settled & (size < _BOTTOM)
    if tight.any():
        size[tight] = (~low[tight] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
    return settled | tight


def encode_blocks(blocks: list[np.ndarray], weights: np.ndarray, shares: np.ndarray) -> list[bytes]:
    """Code blocks side by side. They may differ in length; each result stands alone."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    steps, lanes = int(sizes[0]), len(order)
    ids = np.zeros((steps, lanes), np.int64)
    for k, i in enumerate(order):
        ids[: sizes[k], k] = blocks[i]
    out = np.zeros((lanes, 2 * steps + 8), "<u2")
    used = np.zeros(lanes, np.int64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    model = Model(lanes, weights, shares, inverse=False)
    for t in range(steps):
        m = int(np.searchsorted(-sizes, -t, "left"))
        now = ids[t, :m]
        model.predict(m)
        start, width = model.interval(now, m)
        unit = size[:m] >> np.uint64(_BITS)
        low[:m] += unit * start.astype(np.uint64)
        size[:m] = unit * width.astype(np.uint64)
        while (at := np.flatnonzero(_narrow(low[:m], size[:m]))).size:
            out[at, used[at]] = (low[at] >> np.uint64(48)).astype(np.uint16)
            used[at] += 1
            low[at] <<= _UNIT
            size[at] <<= _UNIT
        model.update(now, m)
    for _ in range(4):
        out[np.arange(lanes), used] = (low >> np.uint64(48)).astype(np.uint16)
        used += 1
        low <<= _UNIT
    found = [b""] * lanes
    for k, i in enumerate(order):
        found[i] = out[k, : used[k]].tobytes()
    return found


def decode_blocks(blobs: list[bytes], lengths: list[int], weights: np.ndarray, shares: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks that ``encode_blocks`` coded."""
    order = sorted(range(len(blobs)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    steps, lanes = int(sizes[0]), len(order)
    data = np.zeros((lanes, max(len(b) for b in blobs) // 2 + 8), np.uint64)
    for k, i in enumerate(order):
        own = np.frombuffer(blobs[i], "<u2")
        data[k, : len(own)] = own
    low, size, code = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0)), np.zeros(lanes, np.uint64)
    for j in range(4):
        code = (code << _UNIT) | data[:, j]
    used = np.full(lanes, 4)
    ids = np.zeros((steps, lanes), np.uint32)
    model = Model(lanes, weights, shares, inverse=True)
    for t in range(steps):
        m = int(np.searchsorted(-sizes, -t, "left"))
        model.predict(m)
        unit = size[:m] >> np.uint64(_BITS)
        target = np.minimum((code[:m] - low[:m]) // unit, np.uint64((1 << _BITS) - 1)).astype(np.int64)
        now, start, width = model.find(target, m)
        low[:m] += unit * start.astype(np.uint64)
        size[:m] = unit * width.astype(np.uint64)
        while (at := np.flatnonzero(_narrow(low[:m], size[:m]))).size:
            code[at] = (code[at] << _UNIT) | data[at, used[at]]
            used[at] += 1
            low[at] <<= _UNIT
            size[at] <<= _UNIT
        model.update(now, m)
        ids[t, :m] = now
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for k, i in enumerate(order):
        found[i] = ids[: sizes[k], k].copy()
    return found


def write_file(out, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
    """Write documents' ids, laid end to end, as one file."""
    size = int(np.clip(-(-len(ids) // LANES), LEAST_BLOCK, BLOCK))
    blocks = [ids[a : a + size] for a in range(0, len(ids), size)]
    weights, shares = shares_of(ids)
    blobs = [x for a in range(0, len(blocks), LANES) for x in encode_blocks(blocks[a : a + LANES], weights, shares)]
    said_shares = zlib.compress(shares.astype("<u2").tobytes())
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + np.asarray(lengths, "<u4").tobytes()
    table = zlib.compress(table)
    head = {"classes": weights.tolist(), "documents": len(docs)}
    head |= {"shares": len(said_shares), "shares_crc32": zlib.crc32(said_shares), "table": len(table), "table_crc32": zlib.crc32(table)}
    head["blocks"] = [[len(b), len(x), zlib.crc32(b.astype("<u4").tobytes())] for b, x in zip(blocks, blobs, strict=True)]
    said = json.dumps(head).encode()
    out.write(MAGIC + struct.pack("<I", len(said)) + said + said_shares + table)
    for x in blobs:
        out.write(x)


def read_file(stream) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a file; a block that was changed raises."""
    if stream.read(8) != MAGIC:
        raise ValueError("not a token-id file")
    head = json.loads(stream.read(struct.unpack("<I", stream.read(4))[0]))
    n, shares, table = head["documents"], stream.read(head["shares"]), stream.read(head["table"])
    if zlib.crc32(table) != head["table_crc32"] or zlib.crc32(shares) != head["shares_crc32"]:
        raise ValueError("the table of documents or of shares is damaged")
    weights, shares = np.array(head["classes"], np.int64), np.frombuffer(zlib.decompress(shares), "<u2")
    table = zlib.decompress(table)
    none = np.frombuffer(table[8 * n : 9 * n], np.uint8).astype(bool).tolist()
    docs = [None if x else d for d, x in zip(np.frombuffer(table[: 8 * n], "<i8").tolist(), none, strict=True)]
    lengths = np.frombuffer(table[9 * n :], "<u4").astype(np.int64)
    parts = []
    for a in range(0, len(head["blocks"]), LANES):
        own = head["blocks"][a : a + LANES]
        for ids, (_, _, crc) in zip(decode_blocks([stream.read(b[1]) for b in own], [b[0] for b in own], weights, shares), own, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block is damaged")
            parts.append(ids)
    return docs, lengths, np.concatenate([*parts, np.zeros(0, np.uint32)])


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
    return Tokenizer.from_file(path)


#: Pieces that a worker keeps, and the longest of them; bytes of text that are cut at once.
KEPT, LONGEST, SLICE_BYTES = 1_000_000, 64, 16 << 20


#: A text that a tokenizer of another kind does not encode piece by piece.
_SHAPES = "An old, tOLD tale.  It's ended...\n\tÉté, 12.5 end."


@lru_cache(maxsize=1)
def pieces(path: str) -> dict[str, bytes]:
    """What a worker process keeps from one task to the next."""
    return {}


def encode_batch(own: Tokenizer, kept: dict[str, bytes], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, each with the end id, and how many each text has.

    The tokenizer lowers case, drops ASCII white space, and parts letters from punctuation. So each piece
    between white space is encoded on its own, in lower case, without a comma or full stop after its last
    letter; and only those that were not seen before. Where a text may hold a special token, case counts.
    """
    texts = texts.fill_null("")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-zÀ-ÖØ-öø-ÿ])([.,])(\s|$)", r"\1 \2\3"))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    new = [w for w in words if w not in kept and w]
    if len(kept) + len(new) > KEPT:
        kept.clear()
        new = [w for w in words if w]
    said = own.encode(" ".join(new), add_special_tokens=False)
    starts = np.cumsum([0, *(len(w) + 1 for w in new)])
    ids = np.array(said.ids, "<u2")
    cuts = np.searchsorted(np.array([a for a, _ in said.offsets], np.int64), starts)  # tokens stand in the order of the text
    fresh = {w: ids[a:b].tobytes() for w, a, b in zip(new, cuts, cuts[1:], strict=False)}
    kept.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
    told = [kept[w] if w in kept else fresh.get(w, b"") for w in words] + [np.array([END], "<u2").tobytes()]
    flat = np.frombuffer(b"".join(told), "<u2")
    sizes = np.array([len(x) // 2 for x in told])
    begin = np.cumsum(sizes) - sizes
    ends = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
    at = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(words))
    many = sizes[at]
    past = np.cumsum(many)
    lengths = np.diff(past[ends + np.arange(len(ends))], prepend=0)
    return flat[np.repeat(begin[at] - past + many, many) + np.arange(int(past[-1]) if len(past) else 0)], lengths


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, ids)`` with the end id; ids as little-endian 16-bit numbers."""
    arrow_rows(docs.sparkSession, 2000)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = tokenizer(path), pieces(path)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids, lengths = encode_batch(own, kept, batch.column(1))
            places = np.concatenate([[0], 2 * np.cumsum(lengths)]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), raw], ["id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(told, "id long, n long, ids binary")


def write_ids(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts and write their ids, in ascending order of document ids, as files.

    ``path`` is a tokenizer that lowers case and cuts letters, digits and other signs apart, without white
    space (another raises an error). Returns the files: ``(part, path, documents, ids)``, in the order of ``part``. A null text is empty and
    has the end id alone; null ids come first; rows that repeat an id stand next to each other, the
    one with the fewer and then smaller ids first.
    """
    spark = docs.sparkSession
    own = tokenizer(path)
    if (size := own.get_vocab_size()) > MOST_IDS:
        raise ValueError(f"{size} ids; a file holds ids below {MOST_IDS}")
    if encode_batch(own, {}, pa.array([_SHAPES]))[0].tolist()[:-1] != own.encode(_SHAPES, add_special_tokens=False).ids:
        raise ValueError("the tokenizer cuts texts in another way")
    folder = folder or fresh_dir(spark, "ids")
    rows = written(encoded(docs, path, id_col, text_col), "encoded")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // file_ids))
    # ranges of ids in ascending order, so that the partition's number is the file's place
    dealt = rows.repartitionByRange(n, "id", "n").sortWithinPartitions("id", "n", "ids")
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("long"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size = None, 0

        def close():
            with created(folder, f"part-{now:06d}.ids") as (out, at):
                ids = np.concatenate([np.frombuffer(h[1], "<u2") for h in held])
                write_file(out, [h[0] for h in held], np.array([len(h[1]) // 2 for h in held]), ids)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, at, len(held), len(ids))], ["part", "path", "documents", "ids"])

        piece = 0
        for batch in batches:
            for id_, ids, k in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "part")), strict=True):
                key = k * 10_000
                if now is not None and (key != now - piece or size >= file_ids):
                    yield close()
                    piece = piece + 1 if key == now - piece else 0
                    held, size = [], 0
                now = key + piece
                held.append((id_, ids))
                size += len(ids) // 2
        if held:
            yield close()

    return written(dealt.select("id", "ids", "part").mapInArrow(told, "part long, path string, documents long, ids long"), "files")


def read_ids(files: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Read listed files: ``(<id_col>, start, n_tokens, ids_crc32[, ids])`` for each document.

    ``start`` counts the ids of all documents before; the CRC is of the ids as 32-bit numbers.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    at = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "start")
    n = max(1, files.count())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as stream:
                    docs, lengths, ids = read_file(stream)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                for a in range(0, len(docs), 2000):
                    own = slice(a, a + 2000)
                    parts = [raw[e - k : e] for e, k in zip(ends[own].tolist(), lengths[own].tolist(), strict=True)]
                    cols = [pa.array(docs[own], pa.int64()), pa.array(start + ends[own] - lengths[own]), pa.array(lengths[own]), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return at.repartition(n).mapInArrow(told, schema)
