"""Repeated windows over symbol sequences: the rounds that both repeat removers share, in packed shuffles.

Round 1 counts anchors and leaves two filters of fixed size: anchors that occur again, and anchors that
occur again with other surroundings (anchors that branch).  Round 2 names whole blocks under an anchor that
occurs again without branching: every occurrence of a block but the first (smallest document, then place) is
covered by earlier windows.  What stands under a branching anchor is compared more finely: as single windows
(words), or by ranks of growing strings (bytes).  A filter may let too much through, never too little
(surroundings are told apart by 63 bits of their names): a full filter costs exchange, not repeats.

Each task first drops what its own texts already decide, so a passage that a third of all documents share
reaches an exchange once per task, not once per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.order import numbered
from .kernels import PACKED, cut, deal, flat, ids_of, in_filter, mix, packed, partitions, task, text_blocks
from .skeleton import Blocks, blocks

FILTER_BITS_EACH = 1 << 20  # per shuffle partition
FILTER_BITS_MOST = 1 << 28  # each filter stays under 32 MB
GATHERED = 1 << 17  # anchors that a task brings together before it ships them
KEY = "__document__"
_U = np.uint64


@dataclass(frozen=True)
class Units:
    """What a sequence is made of: symbols and documents' first symbols from bytes and offsets."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int
    block_bytes: int

    def blocks(self, batches):
        for batch in text_blocks(batches, self.block_bytes):
            symbols, first = self.symbols(*flat(batch.column("text")))
            yield batch, ids_of(batch, KEY), blocks(symbols, first, self.length, self.gram)


def keyed(docs: DataFrame) -> DataFrame:
    """(KEY, then the columns of ``docs``): a number for each document, in the order of doc_id.

    It is the doc_id itself, unless an id stands for several texts (all null ids are one id): then each
    distinct (doc_id, text) is a document, told apart and ordered by a hash of the text after the id.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    bad = docs.groupBy("doc_id").agg((F.min(tag) != F.max(tag)).alias("differ")).where("differ").limit(1).count()
    if not bad:
        return docs.select(F.col("doc_id").cast("long").alias(KEY), "*")
    pairs = numbered(docs.select(F.col("doc_id").alias("__id__"), tag.alias("__tag__")).distinct(), "__id__", "__tag__", name=KEY)
    return docs.join(pairs, docs["doc_id"].eqNullSafe(pairs["__id__"]) & (tag == pairs["__tag__"])).select(pairs[KEY], *(docs[c] for c in docs.columns))


def _places(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor >> _U(20)) % _U(bits)


def _first_of(keys: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """For each entry: the document and start of an earlier entry with its key, or its own if it is the earliest.

    That is the one before in the same document, where there is one (so a text that goes on repeating itself keeps in
    step with one source), else the earliest of all.  A document's entries come together, in rising order.
    """
    order = np.argsort(keys, kind="stable")
    k, d, s = keys[order], doc[order], start[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(begin):
        return doc, start
    group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(k)]])))
    low = np.minimum.reduceat(d, begin)
    at = np.minimum.reduceat(np.where(d == low[group], s, np.iinfo(np.int64).max), begin)
    source, place = low[group], at[group]
    step = np.flatnonzero((k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (s[1:] > s[:-1])) + 1
    source[step], place[step] = d[step - 1], s[step - 1]
    first_doc, first_start = np.empty_like(doc), np.empty_like(start)
    first_doc[order], first_start[order] = source, place
    return first_doc, first_start


def _write(*columns: np.ndarray) -> bytes:
    """Columns behind one another; sorted document ids and starts shrink well in the exchange."""
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def _read(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _planes(x: np.ndarray) -> bytes:
    """Rising numbers as steps, one plane for each byte of a step; the empty planes vanish in the exchange."""
    return np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8, 4 * n, 8).reshape(4, n).T.copy().view("<u4").ravel(), dtype=np.int64)


@dataclass(frozen=True)
class Filters:
    """Which anchors occur again, and which of these branch: a compressed bit field for each partition that has any.

    The fields have room for many anchors, so with few they are almost empty; whole they stand in the workers only.
    """

    again: dict[int, bytes]
    several: dict[int, bytes]
    bits: int
    parts: int

    def _whole(self, fields: dict[int, bytes]) -> np.ndarray:
        width = -(-(-(-self.bits // self.parts)) // 8)
        out = np.zeros(width * self.parts, np.uint8)
        for part, field in fields.items():
            out[part * width : (part + 1) * width] = np.frombuffer(zlib.decompress(field), np.uint8)
        return out

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self._whole(self.again), self._whole(self.several)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Both fields; a worker unpacks them once and keeps them for its next task."""
        return self._tables

    def holds(self, table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        each = -(-self.bits // self.parts)
        place = _places(anchor, self.bits)
        part, local = place // _U(each), place % _U(each)
        at = (part * _U(-(-each // 8)) + local // _U(8)).astype(np.int64)
        return (table[at] >> (local % _U(8)).astype(np.uint8)) & 1 > 0


def filters(docs: DataFrame, units: Units, n: int) -> Filters:
    """Filters over anchors: met again; met again with other surroundings.

    An entry is the anchor's place and as much of the anchor as fits four bytes with it, then the block's
    whole name but its lowest bit, which says whether the task itself has the block more than once.
    """
    bits = min(FILTER_BITS_MOST, n * FILTER_BITS_EACH)
    each = -(-bits // n)
    spare = 32 - (each - 1).bit_length()  # 12 bits at least

    def gathered(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, _, b in units.blocks(batches):
            held.append((b.anchor, b.name))
            size += len(b.anchor)
            if size >= GATHERED:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def count(batches):
        for anchor, name in gathered(batches):
            order = np.lexsort((name, anchor))
            anchor, name = anchor[order], name[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])]) if len(order) else np.zeros(0, bool)
            copies = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
            anchor, name = anchor[new], name[new]
            place = _places(anchor, bits)
            pid = (place // _U(each)).astype(np.int64)
            key = (((place % _U(each)) << _U(spare)) | (anchor & _U((1 << spare) - 1))).astype(np.int64)
            by = np.argsort((pid << 32) | key)
            ends = np.searchsorted(pid[by], np.arange(n + 1))
            key, mark = key[by], (name[by] & ~_U(1)) | (copies[by] > 1).astype("<u8")
            full = np.flatnonzero(np.diff(ends))
            yield packed(full.tolist(), [np.int64(ends[p + 1] - ends[p]).tobytes() + _planes(key[ends[p] : ends[p + 1]]) + mark[ends[p] : ends[p + 1]].tobytes() for p in full])

    def settle(batches):
        pids: list[int] = []
        keys, marks = [], []
        for batch in batches:
            pids.extend(batch.column("pid").to_pylist()[:1])
            for blob in batch.column("blob").to_pylist():
                size = int(np.frombuffer(blob, "<i8", 1)[0])
                keys.append(_from_planes(blob, size).astype("<u4"))
                marks.append(np.frombuffer(blob, "<u8", size, 8 + 4 * size))
        if not keys:
            return
        key, mark = np.concatenate(keys), np.concatenate(marks)
        order = np.argsort(key, kind="stable")
        key, mark = key[order], mark[order]
        local = key >> np.uint32(spare)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([begin, [len(key)]]))
        name = mark & ~_U(1)
        several = np.minimum.reduceat(name, begin) != np.maximum.reduceat(name, begin)
        again = (sizes > 1) | (np.maximum.reduceat(mark & _U(1), begin) > 0)
        out = []
        for hit in (again, several):
            flags = np.zeros(each, bool)
            flags[local[begin[hit]]] = True
            out.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1))
        yield pa.record_batch([pa.array(pids[:1], pa.int32()), pa.array(out[:1], pa.binary()), pa.array(out[1:], pa.binary())], ["pid", "again", "several"])

    found = deal(docs.select(KEY, "text").mapInArrow(task(count), PACKED), n).mapInArrow(task(settle), "pid int, again binary, several binary")
    rows = found.collect()  # two bit fields for each partition, of bounded size together
    return Filters({r.pid: bytes(r.again) for r in rows}, {r.pid: bytes(r.several) for r in rows}, bits, n)


def _doc_pid(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % _U(n)).astype(np.int64)


def covered(docs: DataFrame, units: Units, known: Filters, windows: bool = True) -> DataFrame:
    """Packed rows by document: ranges (start, end) covered by earlier windows, with the source's place.

    ``source`` and ``source_start`` say where the same symbols stand earlier.  Blocks under branching anchors are
    compared window by window, or left to the caller.  A window is in one range at most.
    """
    n = known.parts
    shared_filters = docs.sparkSession.sparkContext.broadcast(known)
    length = units.length

    def emit(kind: int, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray):
        order = np.lexsort((start, doc, (keys % _U(n)).astype(np.uint16 if n <= 65536 else np.uint32)))
        keys, doc, start, count = keys[order], doc[order], start[order], count[order]
        ends = np.searchsorted((keys % _U(n)).astype(np.int64), np.arange(n + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[p], ends[p + 1])
            step = np.diff(start[s], prepend=0)
            yield p, bytes([kind]) + _write(keys[s], np.diff(doc[s], prepend=0), step.astype("<i4"), count[s].astype("<u2"))

    def name_blocks(batches):
        known = shared_filters.value
        repeated, branching = known.tables()
        for _, ids, b in units.blocks(batches):
            live = np.flatnonzero(known.holds(repeated, b.anchor))
            branch = known.holds(branching, b.anchor[live])
            if not windows:
                live, branch = live[~branch], np.zeros(int((~branch).sum()), bool)
            if not len(live):
                continue
            doc, name = ids[b.doc[live]], b.name[live]
            first_doc, first_low = _first_of(name, doc, b.low[live])
            own = (first_doc == doc) & (first_low == b.low[live])
            whole = own & ~branch
            rows = list(emit(0, name[whole], doc[whole], b.low[live][whole], b.count[live][whole]))
            late = ~own
            if late.any():  # decided here; goes on as a finding
                rows += list(findings(doc[late], b.low[live][late], b.low[live][late] + b.count[live][late] - 1 + length, first_doc[late], first_low[late], n, bytes([2])))
            loose = live[own & branch]
            if len(loose):
                at, start, key = b.windows(loose, length)
                at = ids[at]
                first_doc, first_start = _first_of(key, at, start)
                own = (first_doc == at) & (first_start == start)
                rows += list(emit(1, key[own], at[own], start[own], np.ones(int(own.sum()), np.int64)))
                if not own.all():
                    rows += list(findings(at[~own], start[~own], start[~own] + length, first_doc[~own], first_start[~own], n, bytes([2])))
            yield packed([p for p, _ in rows], [x for _, x in rows])

    def settle(batches):
        parts: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            ready: list[tuple[int, bytes]] = []
            for pid, blob in zip(batch.column("pid").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if blob[0] == 2:
                    ready.append((pid, blob[1:]))
                else:
                    key, doc, start, count = _read(blob[1:], "<u8", "<i8", "<i4", "<u2")
                    parts[blob[0]].append((key, np.cumsum(doc), np.cumsum(start.astype(np.int64)), count))
            if ready:
                yield packed([p for p, _ in ready], [x for _, x in ready])
        for kind in (0, 1):
            if parts[kind]:
                key, doc, start, count = (np.concatenate(x) for x in zip(*parts[kind], strict=True))
                parts[kind] = []
                first_doc, first_start = _first_of(key, doc, start)
                late = (first_doc != doc) | (first_start != start)
                rows = list(findings(doc[late], start[late], start[late] + count[late].astype(np.int64) - 1 + length, first_doc[late], first_start[late], n, b""))
                yield packed([p for p, _ in rows], [x for _, x in rows])

    named = deal(docs.select(KEY, "text").mapInArrow(task(name_blocks), PACKED), n)
    return named.mapInArrow(task(settle), PACKED)


def findings(doc, start, end, source, source_start, n: int, mark: bytes = b"", join: bool = True):
    """Packed findings by document; neighbouring ranges with the same source run are joined first, if asked for."""
    order = np.lexsort((start, doc))
    doc, start, end, source, source_start = doc[order], start[order], end[order], source[order], source_start[order]
    if join and len(doc):
        follows = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (start[1:] <= end[:-1]) & (source_start[1:] - start[1:] == source_start[:-1] - start[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~follows]))
        end = np.maximum.reduceat(end, begin)
        doc, start, source, source_start = doc[begin], start[begin], source[begin], source_start[begin]
    pid = _doc_pid(doc, n)
    order, ends = cut(pid, n)
    doc, start, end, source, source_start = doc[order], start[order], end[order], source[order], source_start[order]
    for p in np.flatnonzero(np.diff(ends)).tolist():
        s = slice(ends[p], ends[p + 1])
        yield p, mark + _write(np.diff(doc[s], prepend=0), start[s].astype("<i4"), (end - start)[s].astype("<i4"), source[s] - doc[s], source_start[s].astype("<i4"))


def read_findings(blob: bytes):
    doc, start, size, source, source_start = _read(blob, "<i8", "<i4", "<i4", "<i8", "<i4")
    doc = np.cumsum(doc)
    return doc, start.astype(np.int64), start + size.astype(np.int64), source + doc, source_start.astype(np.int64)


TEXTS = b"\xff\xff\xff\xff"  # no count of findings begins like this


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def with_texts(docs: DataFrame, found_rows: DataFrame, n: int, finish, schema, wanted: np.ndarray | None = None, others: bool = True) -> DataFrame:
    """Brings texts and findings of a document together and calls ``finish(batch, ranges)`` on batches of ``docs``.

    ``ranges`` maps a document's KEY to its (start, end, source, source_start) rows, in no order.  With ``wanted``,
    a filter over KEYs that have findings, only such texts travel; the ``others`` are finished where they are read.
    """
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def blocks(batches, hit: bool = True):
        for block in text_blocks(batches):
            if sent is not None:
                at = np.flatnonzero(in_filter(sent.value, ids_of(block, KEY)) == hit)
                if not len(at):
                    continue
                block = block.take(pa.array(at)) if len(at) < block.num_rows else block
            yield block

    def place(batches):
        """Texts by document, many in one compressed row."""
        for block in blocks(batches):
            order, ends = cut(_doc_pid(ids_of(block, KEY), n), n)
            full = np.flatnonzero(np.diff(ends)).tolist()
            yield packed(full, [TEXTS + _ipc(block.take(pa.array(order[ends[p] : ends[p + 1]]))) for p in full])

    def untouched(batches):
        for block in blocks(batches, hit=False):
            yield finish(block, lambda key: [np.zeros(0, np.int64)] * 4)

    rows = docs.mapInArrow(task(place), PACKED).unionByName(found_rows)

    def run(batches):
        held, found = [], []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                if blob[:4] == TEXTS:
                    held += pa.ipc.open_stream(blob[4:]).read_all().to_batches()
                else:
                    found.append(read_findings(blob))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]

        def ranges(doc: int):
            a, b = np.searchsorted(columns[0], [doc, doc + 1]) if doc < 2**63 - 1 else (np.searchsorted(columns[0], doc), len(columns[0]))
            return tuple(c[a:b] for c in columns[1:])

        while held:
            for part in text_blocks([held.pop()]):
                yield finish(part, ranges)

    met = deal(rows, n).mapInArrow(task(run), schema)
    return met if sent is None or not others else met.unionByName(docs.mapInArrow(task(untouched), schema))


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered symbols; ranges that only touch are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


__all__ = ["Blocks", "Filters", "Units", "covered", "filters", "findings", "keyed", "partitions", "read_findings", "union_of", "with_texts"]
