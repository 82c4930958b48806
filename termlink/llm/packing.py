"""Packing (best-fit decreasing) of tokenised documents into fixed windows.

A document's ids (then one id 0) are cut into full windows first; what is left, shorter than a window,
goes to the open window with the least sufficient room, which a segment tree over remaining capacity
finds in O(log window).  Work is one pass over the input split: tokenising and packing happen in the
same task, nothing is shuffled, and a task holds lengths only, ``flush`` remainders at a time.

Tokenising is by dictionary of units.  A unit ends before each single space between two visible
characters; the pre-tokeniser's pattern always cuts there, so a unit's ids do not depend on its
neighbours.  Each distinct unit is encoded once per task and its ids are gathered by array indexing.

Nulls and edge cases: a null or empty text is the lone id 0; a null doc_id stays null; repeated rows
are packed each on their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import SYMBOL, flat, id_array, ids_of, prefix_hash, ragged, range_hash, task, text_blocks

WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_VISIBLE = np.zeros(256, bool)  # bytes that surely belong to a visible character, seen from either side
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)  # first bytes of two-byte characters of which none is white space
_LEAD[0xC3:0xE0] = True


def unit_bounds(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units, with the total length at the end; every document starts one (if not empty)."""
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 0) & (at < len(buf) - 1)]
    before = _VISIBLE[buf[at - 1]] | ((buf[at - 1] >= 0x80) & (at > 1) & _LEAD[buf[np.maximum(at - 2, 0)]])
    after = _VISIBLE[buf[at + 1]] | _LEAD[buf[at + 1]]
    starts = np.zeros(len(buf) + 1, bool)
    starts[at[before & after]] = True
    starts[offsets] = True
    return np.flatnonzero(starts)


class UnitIds:
    """Ids of units, looked up by identity; ``encode`` gets the texts of new units in groups."""

    def __init__(self, encode_many, keep: int = 2_000_000) -> None:
        self.encode_many, self.keep = encode_many, keep
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __call__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray):
        """For each unit: where its ids start in ``flat``, and how many they are."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self.clear()
        at = np.searchsorted(self.known, unique)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == unique[hit]
        new = ~hit
        if new.any():
            texts = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids, counts = self.encode_many(texts)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            slots = np.arange(len(self.count), len(self.count) + len(counts))
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, ids])
            self.known, self.slot = np.insert(self.known, at[new], unique[new]), np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.known, unique)
        slot = self.slot[at]
        return self.start[slot][inverse], self.count[slot][inverse]


class BpeUnits:
    """Encodes units with a byte-level tokenizer file, many at a time as one text.

    Units that begin with their space can stand one behind the other without touching, so a group of
    them is one call; the known byte length of every id gives the boundaries back.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in self.model.get_added_tokens_decoder().items()}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = special.get(i, len(piece))  # a byte is one character of a piece

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in texts], np.int64)
        joined = np.array([x[:1] == b" " and len(x) > 1 and x[1:2] != b" " and len(x) < 4096 and x[-1] > 0x20 for x in texts], bool)
        where = np.flatnonzero(joined)
        single = np.flatnonzero(~joined).tolist()
        units, counts, parts = [], [], []
        for group in np.split(where, np.searchsorted(np.cumsum(lengths[where]), np.arange(1 << 16, int(lengths[where].sum()) + 1, 1 << 16))):
            if not len(group):
                continue
            ids = np.array(self._ids(b"".join(texts[i] for i in group.tolist()).decode("utf-8", "replace")), np.int32)
            ends, wanted = np.cumsum(self.width[ids]), np.cumsum(lengths[group])
            cuts = np.searchsorted(ends, wanted)
            if len(ends) and cuts[-1] == len(ends) - 1 and (ends[cuts] == wanted).all():
                units.append(group)
                counts.append(np.diff(cuts, prepend=-1))
                parts.append(ids)
            else:
                single += group.tolist()
        for i in single:
            ids = np.array(self._ids(texts[i].decode("utf-8", "replace")), np.int32)
            units.append(np.array([i]))
            counts.append(np.array([len(ids)]))
            parts.append(ids)
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, count = np.argsort(np.concatenate(units)), np.concatenate(counts)
        return np.concatenate(parts)[ragged((np.cumsum(count) - count)[order], count[order])], count[order]


def token_blocks(batches, encoder: UnitIds):
    """Per block of documents: the batch, all ids, and each document's number of ids."""
    for block in text_blocks(batches):
        buf, offsets = flat(block.column("text"))
        bounds = unit_bounds(buf, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        begin, count = encoder(buf.tobytes(), starts, ends, range_hash(prefix_hash(SYMBOL[buf]), starts, ends))
        per_unit = np.concatenate([[0], np.cumsum(count)])
        yield block, encoder.flat[ragged(begin, count)], np.diff(per_unit[np.searchsorted(bounds, offsets)])


_encoders: dict[str, UnitIds] = {}


def bpe_units(path: str) -> UnitIds:
    """The unit dictionary of a tokenizer file, kept by a worker between its tasks."""
    if path not in _encoders:
        _encoders[path] = UnitIds(BpeUnits(path))
    return _encoders[path]


class OpenWindows:
    """Segment tree over remaining capacity: ``fit`` takes the tightest window with enough room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # windows below each node
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def fit(self, size: int) -> tuple[int, int]:
        """Window and offset for ``size`` ids; opens one if none has the room."""
        node = size + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):  # up, until something opens to the right
                node >>= 1
            if node <= 1:
                self.used.append(0)
                node = 0
            else:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
        if node:
            room = node - self.leaves
            window = self.at[room].pop()
            self._count(room, -1)
        else:
            room, window = self.capacity, len(self.used) - 1
        offset = self.used[window]
        self.used[window] += size
        if room > size:
            self.at[room - size].append(window)
            self._count(room - size, 1)
        return window, offset


def pack_lengths(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: window and offset of every size (1 .. capacity), and the windows used."""
    windows, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = OpenWindows(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        windows[i], offsets[i] = tree.fit(int(sizes[i]))
    return windows, offsets, len(tree.used)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0, flush: int = 200_000) -> DataFrame:
    """One row per piece: its document, place in it, CRC of its ids, and its place in a sequence.

    sequence_id is the input partition's number (upper bits) with a count, so a retried task gives the
    same ids again.  Each ``flush`` remainders are packed on their own to bound memory.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        from pyspark import TaskContext

        encoder = bpe_units(tokenizer)
        base, used = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        rows: list[list[np.ndarray]] = []

        def settle():
            nonlocal used, rows
            if not rows:
                return
            doc, start, length, crc, total = (np.concatenate(x) for x in zip(*rows, strict=True))
            sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            full = length == window
            sequence[full] = np.arange(full.sum())
            sequence[~full], offset[~full], more = pack_lengths(length[~full], window)
            sequence[~full] += full.sum()
            sequence += base + used
            used += int(full.sum()) + more
            rows = []
            for a in range(0, len(doc), 100_000):
                s = slice(a, a + 100_000)
                yield pa.record_batch([id_array(doc[s]), *(pa.array(x[s], pa.int64()) for x in (start, length, crc, total, sequence, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for block, ids, counts in token_blocks(batches, encoder):
            total = counts + 1
            tokens = np.full(int(total.sum()), end_id, "<u4")
            first = np.cumsum(total) - total
            tokens[ragged(first, counts)] = ids
            pieces = -(-total // window)
            start = (ragged(np.zeros(len(total), np.int64), pieces)) * window
            doc = np.repeat(np.arange(len(total)), pieces)
            length = np.minimum(window, total[doc] - start)
            raw, at = memoryview(tokens.tobytes()), first[doc] + start
            crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], np.int64)
            rows.append([ids_of(block)[doc], start, length, crc, total[doc]])
            held += len(doc)
            if held >= flush:
                yield from settle()
                held = 0
        yield from settle()

    return docs.select("doc_id", "text").mapInArrow(task(run), SCHEMA)

