"""Substring dedup over UTF-8 bytes by prefix doubling over sampled suffixes.

Suffixes are ranked at anchors only: of the 32-byte strings in each 100-byte string one is its anchor, the
same wherever that string stands, so a sample of about two suffixes in 70 bytes meets every repeat.  An
anchor's first name covers its 32 bytes; anchors that occur once leave at the first filter, and where all
surroundings of an anchor agree past the threshold, whole blocks of strings are settled by their names.

At the anchors that branch, ranks grow.  The strings around an anchor begin 0 to 68 bytes before it.  A node
is a range of such beginnings, and its string the bytes that all of them share, 32 for the whole range.  In
each round Spark sorts (rank, next bytes, place); equal pairs get the place of the first of them in the order
as their new rank, places without an equal leave, and nodes are halved, so that their strings grow from 32 by
34, 17, 9 ... bytes up to 100, to the right for the nearer half and to the left for the farther.  Places whose
remaining bytes agree too are past the threshold at once: all but the first are covered.  The order is total
over range partitions, so a rank that many places share spreads over many tasks, and no group is held.

A byte goes if a 100-byte string over it also starts earlier (smaller doc_id, or same document, earlier
start); overlaps count; strings are judged on the input and lie in one document.

Nulls and edge cases: a null or empty text has no bytes; a null doc_id orders before all others; rows that
repeat a doc_id with the same text are one document and get equal results; different texts under one doc_id
are documents of their own, ordered by a hash of the text; empty tables give no rows; no other column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .kernels import PACKED, SYMBOL, flat, id_array, ids_of, packed, shared, task
from .repeats import KEY, Filters, Units, _first_of, _ipc, covered, filters, findings, keyed, partitions, union_of, with_texts

LENGTH, GRAM = 100, 32
UNITS = Units(lambda buf, offsets: (SYMBOL[buf], offsets), LENGTH, GRAM, 1 << 19)
PAIRS = "rank long, node int, next binary, left binary, right binary, doc long, at long"
ORDER = ["rank", "node", "next", "left", "right", "doc", "at"]
GROUP = 3  # columns of ORDER that make a pair
BLOCK = 1 << 16  # places for each range partition of a later round
HELD = "part int, pid int, blob binary, places long, first struct<rank:long,node:int,next:binary>, last struct<rank:long,node:int,next:binary>"


def _nodes() -> list[list[tuple[int, int]]]:
    """By round: ranges of beginnings, counted in bytes before the anchor; node i has children 2i and 2i + 1."""
    rounds = [[(0, LENGTH - GRAM)]]
    while any(a < b for a, b in rounds[-1]):
        rounds.append([half for a, b in rounds[-1] for half in ((a, (a + b) // 2), ((a + b) // 2 + 1, b))])
    return rounds


NODES = _nodes()
A0, A1 = (np.array([0, *(node[k] for nodes in NODES for node in nodes)]) for k in (0, 1))  # by number of the node


def _tail(x: pa.Array, n: int) -> pa.Array:
    return pc.binary_slice(x, -n) if n else pc.binary_slice(x, 0, 0)


def _halves(rank: np.ndarray, node: np.ndarray, left: pa.Array, right: pa.Array, doc: np.ndarray, at: np.ndarray):
    """Places with the next bytes of either half of their nodes, where they have strings that begin there.

    ``left`` ends where the node's string begins and ``right`` begins where it ends; they reach as far as the
    place's own strings do, so their lengths say which beginnings it has.
    """
    for number in np.unique(node).tolist():
        a0, a1 = int(A0[number]), int(A1[number])
        if a0 == a1:
            continue
        rows, middle = np.flatnonzero(node == number), (a0 + a1) // 2
        before, behind = left.take(pa.array(rows)), right.take(pa.array(rows))
        near, far = a1 - _lengths(behind), a0 + _lengths(before)
        for half, use in ((0, np.flatnonzero(near <= middle)), (1, np.flatnonzero(far > middle))):
            x, y, i = before.take(pa.array(use)), behind.take(pa.array(use)), rows[use]
            if half:
                grown = middle + 1 - a0
                strings = _tail(x, grown), pc.binary_slice(x, 0, -grown), pc.binary_slice(y, 0, a1 - middle - 1)
            else:
                strings = pc.binary_slice(y, 0, a1 - middle), _tail(x, middle - a0), pc.binary_slice(y, a1 - middle, LENGTH)
            yield pa.record_batch([pa.array(rank[i]), pa.array(np.full(len(i), 2 * number + half, np.int32)), *strings, pa.array(doc[i]), pa.array(at[i])], ORDER)


def _lengths(x: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(x)).astype(np.int64)


def _agree(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """For each row but the first, whether it has the same first columns as the row before."""
    n = batch.num_rows
    same = np.ones(max(n - 1, 0), bool)
    for c in ORDER[:columns] if n > 1 else ():
        x = batch.column(c)
        same &= np.asarray(pc.equal(x.slice(1), x.slice(0, n - 1)))
    return same


def _row(batch: pa.RecordBatch, i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in ORDER)


def _first_pairs(docs: DataFrame, known: Filters) -> DataFrame:
    """The places of branching anchors with both halves of their strings, in blocks (pid -1), and findings for the
    places whose whole surroundings an earlier one in the same block of texts has."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = sent.value
        _, branching = known.tables()
        for batch, ids, b in UNITS.blocks(batches):
            live = np.flatnonzero(known.holds(branching, b.anchor))
            if not len(live):
                continue
            doc, low, count = ids[b.doc[live]], b.low[live], b.count[live]
            first_doc, first_low = _first_of(b.name[live], doc, low)
            own = (first_doc == doc) & (first_low == low)
            late = list(findings(doc[~own], low[~own], (low + count - 1 + LENGTH)[~own], first_doc[~own], first_low[~own], known.parts)) if not own.all() else []
            if late:
                yield packed([p for p, _ in late], [x for _, x in late])
            raw, begin = flat(batch.column("text"))[0].tobytes(), b.first[b.doc[live]]
            begin, at = begin[own], b.at[live][own]
            ends = (begin + low[own], begin + at, begin + at + GRAM, begin + (low + count)[own] - 1 + LENGTH)
            left, right = (pa.array([raw[x:y] for x, y in zip(f.tolist(), t.tolist(), strict=True)], pa.binary()) for f, t in (ends[:2], ends[2:]))
            halves = _halves(b.anchor[live][own].view(np.int64), np.ones(len(at), np.int32), left, right, doc[own], at)
            blobs = [_ipc(half) for half in halves]
            yield packed([-1] * len(blobs), blobs)

    return docs.select(KEY, "text").mapInArrow(task(run), PACKED)


def _unpacked(batches):
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            yield from pa.ipc.open_stream(blob)


def _settle(n: int):
    """Over sorted places: those after the first with equal bytes become findings; the first go on, in blocks."""
    pair = pa.struct([("rank", pa.int64()), ("node", pa.int32()), ("next", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("pid", pa.int32()), ("blob", pa.binary()), ("places", pa.int64()), ("first", pair), ("last", pair)])

    def run(batches):
        part, last, source = TaskContext.get().partitionId(), None, (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, node = (np.asarray(batch.column(c)) for c in ("doc", "at", "node"))
            first = np.concatenate([[_row(batch, 0)[:5] != last], ~_agree(batch, 5)])
            of = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            from_doc, from_at = np.where(of < 0, source[0], doc[of]), np.where(of < 0, source[1], at[of])
            far, near = A0[node] + _lengths(batch.column("left")), A1[node] - _lengths(batch.column("right"))  # the beginnings that it has
            late = ~first
            rows = [(part, pid, blob, 0, None, None) for pid, blob in findings(doc[late], (at - far)[late], (at - near)[late] + LENGTH, from_doc[late], (from_at - far)[late], n)] if late.any() else []
            kept = batch.filter(pa.array(first))
            if kept.num_rows:
                rows.append((part, -1, _ipc(kept), kept.num_rows, *(dict(zip(ORDER[:GROUP], _row(kept, i), strict=False)) for i in (0, kept.num_rows - 1))))
            last, source = _row(batch, batch.num_rows - 1)[:5], (int(from_doc[-1]), int(from_at[-1]))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _ranks(held: DataFrame) -> tuple[dict, int]:
    """By range partition: the places before it, the rank of its first pair if that begins in an earlier partition,
    and its last pair if that goes on in the next; and all places.  One row for each partition is gathered."""
    figures = held.where("pid = -1").groupBy("part").agg(F.sum("places").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    rows = sorted(figures.collect(), key=lambda r: r.part)
    out, before, crossing = {}, 0, None
    for i, r in enumerate(rows):
        follows = i > 0 and rows[i - 1].last == r.first
        goes_on = i + 1 < len(rows) and rows[i + 1].first == r.last
        out[r.part] = (before, crossing if follows else None, (r.last.rank, r.last.node, bytes(r.last.next)) if goes_on else None)
        if goes_on and not (follows and r.first == r.last):
            crossing = -1 - r.part  # such a pair is called after the partition where it begins
        before += r.n
    return out, before


def _next_pairs(held: DataFrame, ranks: dict) -> DataFrame:
    """Halves of the places that share their pair with others; the rank is the first such place's in the order."""

    def halves(batch, rank):
        doc, at, node = (np.asarray(batch.column(c)) for c in ("doc", "at", "node"))
        return _halves(rank, node, batch.column("left"), batch.column("right"), doc, at)

    def run(batches):
        place, pair, rank, alone = None, None, 0, None  # the last pair so far, and its row if it has but one
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                begins = place is None
                if begins:
                    place, inherited, goes_on = ranks[part]
                for rows in pa.ipc.open_stream(blob):
                    n = rows.num_rows
                    new = np.concatenate([[_row(rows, 0)[:GROUP] != pair], ~_agree(rows, GROUP)])
                    at = np.flatnonzero(new)
                    group = np.cumsum(new) - 1  # -1 where the last block's pair goes on
                    size = np.bincount(group + 1, minlength=len(at) + 1)
                    name = np.concatenate([[rank], place + at])
                    shared_ = np.concatenate([[True], size[1:] > 1])
                    if not new[0] and alone is not None:
                        yield from halves(alone, np.array([rank]))
                    if begins and inherited is not None:  # others stand in the partition before
                        name[1], shared_[1] = inherited, True
                    pair = _row(rows, n - 1)[:GROUP]
                    if pair == goes_on and len(at) and not (begins and inherited is not None and len(at) == 1):  # or in the next
                        name[-1], shared_[-1] = -1 - part, True
                    rank, begins = int(name[-1]), False
                    alone = None if shared_[-1] or not len(at) else rows.slice(n - 1)
                    use = shared_[group + 1]
                    yield from halves(rows.filter(pa.array(use)), name[group + 1][use])
                    place += n

    return held.where("pid = -1").select("part", "blob").mapInArrow(task(run), PAIRS)


def _found(docs: DataFrame, n: int) -> DataFrame:
    """Packed findings of all rounds, by document (``docs`` has KEY)."""
    known = filters(docs, UNITS, n)
    first = shared(_first_pairs(docs, known))
    found = covered(docs, UNITS, known, windows=False).unionByName(first.where("pid >= 0"))
    pairs, parts = first.where("pid = -1").mapInArrow(_unpacked, PAIRS), n
    for level in range(1, len(NODES)):
        ordered = pairs.repartitionByRange(parts, *ORDER[:5]).sortWithinPartitions(*ORDER)
        held = shared(ordered.mapInArrow(task(_settle(n)), HELD))
        found = found.unionByName(held.where("pid >= 0").select("pid", "blob"))
        ranks, places = _ranks(held)
        if not places or level + 1 == len(NODES):
            break
        pairs, parts = _next_pairs(held, ranks), min(n, 1 + places // BLOCK)
    return found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, start and end (bytes, end exclusive) of every maximal removed run."""
    docs = keyed(docs.select("doc_id", "text"))
    n = partitions(docs.sparkSession)

    def finish(batch, ranges):
        seen = dict(zip(ids_of(batch, KEY).tolist(), ids_of(batch).tolist(), strict=True))
        runs = [(d, *union_of(*ranges(key)[:2])) for key, d in seen.items()]
        doc = np.concatenate([np.full(len(s), d, np.int64) for d, s, _ in runs])
        return pa.record_batch([id_array(doc), *(pa.array(np.concatenate([r[k] for r in runs]), pa.int64()) for k in (1, 2))], ["doc_id", "start", "end"])

    return with_texts(docs, _found(docs, n), n, finish, "doc_id long, start long, end long")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes and runs removed, and a hash of what is left."""
    docs = keyed(docs.select("doc_id", "text"))
    n = partitions(docs.sparkSession)

    def finish(batch, ranges):
        buf, offsets = flat(batch.column("text"))
        raw, rows = buf.tobytes(), []
        for i, key in enumerate(ids_of(batch, KEY).tolist()):
            text = raw[offsets[i] : offsets[i + 1]]
            low, high = union_of(*ranges(key)[:2])
            left, at = hashlib.sha256(), 0
            for s, e in zip(low.tolist(), high.tolist(), strict=True):
                left.update(text[at:s])
                at = e
            left.update(text[at:])
            rows.append((len(text), int((high - low).sum()), len(low), left.hexdigest()))
        size, removed, runs, sha = zip(*rows, strict=True)
        return pa.record_batch([id_array(ids_of(batch)), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_texts(docs, _found(docs, n), n, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def oracle() -> str:
    """DuckDB SQL for ``digest`` (doc_id unique), over hexadecimal digits, two for a byte."""
    return f"""WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) i FROM d WHERE length(h) >= {2 * LENGTH})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) r FROM s) WHERE r > 1),
runs AS (SELECT doc_id, g, min(i) a, max(i) + {LENGTH} b FROM (SELECT doc_id, i, sum(CASE WHEN i - p <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM late)) GROUP BY ALL),
cutted AS (SELECT doc_id, string_agg(substr(h, 2 * coalesce(pb, 0) + 1, 2 * (a - coalesce(pb, 0))), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) kept, count(*) n, sum(b - a) removed FROM (SELECT r.*, h, lag(b) OVER (PARTITION BY doc_id ORDER BY a) pb FROM runs r JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(removed, 0)::BIGINT n_removed, coalesce(n, 0)::BIGINT n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 FROM d LEFT JOIN cutted USING (doc_id)"""
