"""Jaccard join of documents by token-combination prefixes.

A document is the set of its 5-word shingles (A-Z lower-cased).  Documents with one set are one class
from the start.  Two sets of similarity 0.75 or more share a key among:

* single tokens that are rare, from a prefix of ``size - ceil(0.75 size) + 1`` tokens, rare ones first;
* where the rare ones do not fill the prefix, pairs of frequent tokens.  The prefix is then extended by a
  token for each token class it touches, and only tokens of one class (a hash class, as many as an eighth
  of the set's size) are combined: sets that share no such pair share at most one token of each class.

Small sets use single tokens only.  Schemes depend on the size's power of two; each set takes part in its
own and the next, so every pair with sizes within 3:4 meets in one.  Which tokens count as frequent only
steers the work, never the result.

Pairs met under rare tokens must also share enough of their prefixes to reach the overlap at all.  What
remains connects sets into loose groups.  A small group is compared in full.  In a larger one all sets are
compared with a few pivots first, and then only sets that do not hang together through these with everyone.

Nulls and edge cases: a null, empty or blank text has no shingles and links with nothing; with one to four
words the whole sequence is the only shingle; a null doc_id orders before all others; repeated rows are
copies; an empty table gives no rows; other columns pass through ``keep_one`` untouched.  Shingles and sets
are told apart by 64-bit identities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, find_roots, without
from .kernels import LOWER, NULL_ID, PACKED, cut, deal, flat, ids_of, mix, packed, partitions, ragged, shared, task, text_blocks, word_hashes, words_of
from .repeats import _read, _write

SHINGLE = 5
FREQUENT_LEVEL = 6  # frequent from 2**6 documents on; more if the table of frequent tokens would not stay small
FREQUENT_MOST = 2_000_000
BUCKET = 64  # larger buckets connect their members by a star instead of by pairs
GROUP_BLOCK = 384  # sets compared together in memory
PIVOTS = 16  # of a larger group
WHOLE, PIVOTED = -1, -2  # kinds of tasks beside pairs of blocks
FILTER_BITS = 1 << 26
_U = np.uint64


def overlap(size_a, size_b):
    """Least intersection for similarity 0.75: ceil(3 (a + b) / 7)."""
    return (3 * (size_a + size_b) + 6) // 7


def prefix_size(size):
    return size - (3 * size + 3) // 4 + 1


class Sets:
    """Sets of some documents: distinct tokens, ascending within each, and their signatures."""

    def __init__(self, batch) -> None:
        self.ids = ids_of(batch)
        buf, offsets = flat(batch.column("text"))
        buf = LOWER[buf]
        starts, ends, first = words_of(buf, offsets)
        words = word_hashes(buf, starts, ends)
        count = np.diff(first)
        shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
        at = ragged(first[:-1], shingles)
        doc = np.repeat(np.arange(len(count)), shingles)
        length = np.minimum(count, SHINGLE)[doc]
        token = length.astype(np.uint64)
        for i in range(SHINGLE):
            use = length > i
            token = np.where(use, (token * _U(0x9E3779B97F4A7C15)) ^ words[np.minimum(at + i, max(len(words) - 1, 0))], token) if len(words) else token
            token = mix(token)
        order = np.argsort(token)
        order = order[np.argsort(doc[order].astype(np.uint16 if len(count) < 65536 else np.uint32), kind="stable")]
        token, doc = token[order], doc[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(token) else np.zeros(0, bool)
        self.token, self.doc = token[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(count)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([[_U(0)], np.cumsum(mix(self.token ^ _U(0xA0761D6478BD642F)))])
        self.sig = mix((total[self.first[1:]] - total[self.first[:-1]]) + self.size.astype(np.uint64))

    def distinct(self) -> np.ndarray:
        """One document of each set in the batch, those without shingles left out."""
        _, at = np.unique(self.sig, return_index=True)
        return at[self.size[at] > 0]


def _sets(batches):
    for batch in text_blocks(batches):
        yield Sets(batch)


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, sig and n_shingles of every row."""

    def run(batches):
        for s in _sets(batches):
            yield pa.record_batch([pa.array(s.ids), pa.array(s.sig.view(np.int64)), pa.array(s.size)], ["doc_id", "sig", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, sig long, n_shingles long")


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Slots (partition and 32 bits of a token) that many sets fill, ascending; at most FREQUENT_MOST."""

    def count(batches):
        for s in _sets(batches):
            use = s.token[np.isin(s.doc, s.distinct())]
            order, ends = cut((use % _U(n)).astype(np.int64), n)
            slot = (use[order] >> _U(32)).astype("<u4")
            full = np.flatnonzero(np.diff(ends))
            yield packed(full.tolist(), [slot[ends[p] : ends[p + 1]].tobytes() for p in full])

    def settle(batches):
        pids, blobs = [], []
        for batch in batches:
            pids += batch.column("pid").to_pylist()
            blobs += batch.column("blob").to_pylist()
        if not blobs:
            return
        slots, counts = np.unique(np.frombuffer(b"".join(blobs), "<u4"), return_counts=True)
        level = np.log2(counts).astype(np.int32)
        for at in np.unique(level[level >= FREQUENT_LEVEL]).tolist():
            mine = slots[level == at]
            yield pa.record_batch([pa.array(pids[:1], pa.int32()), pa.array([at], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([mine.tobytes()], pa.binary())], ["pid", "level", "n", "blob"])

    found = shared(deal(docs.mapInArrow(task(count), PACKED), n).mapInArrow(task(settle), "pid int, level int, n long, blob binary"))
    total, least = 0, 99
    for level, size in sorted(((r.level, r.n) for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True):
        total += size
        if total > FREQUENT_MOST:
            break
        least = level
    rows = found.where(F.col("level") >= least).select("pid", "blob").collect()
    parts = [(np.frombuffer(r.blob, "<u4").astype(np.uint64) << _U(32)) | _U(r.pid) for r in rows]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _is_frequent(token: np.ndarray, slots: np.ndarray, coarse: np.ndarray, n: int) -> np.ndarray:
    hit = coarse[(token >> _U(40)).astype(np.int64)]
    slot = (token[hit] >> _U(32) << _U(32)) | (token[hit] % _U(n))
    at = np.searchsorted(slots, slot)
    hit[hit] = (at < len(slots)) & (slots[np.minimum(at, max(len(slots) - 1, 0))] == slot) if len(slots) else False
    return hit


def pair_keys(tokens: np.ndarray, missing: int, classes: int) -> np.ndarray:
    """Pairs of one class among the first frequent tokens; ``missing`` is what rare ones left open."""
    group = ((tokens >> _U(7)) % _U(classes)).astype(np.int64)
    _, first = np.unique(group, return_index=True)
    fresh = np.zeros(len(tokens), np.int64)
    fresh[first] = 1
    enough = np.flatnonzero(np.arange(1, len(tokens) + 1) - np.cumsum(fresh) >= missing)
    take = enough[0] + 1 if len(enough) else len(tokens)
    tokens, group = tokens[:take], group[:take]
    order = np.argsort(group, kind="stable")
    tokens, group = tokens[order], group[order]
    out, step = [], 1
    while True:
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            return mix(np.concatenate(out) + _U(classes)) if out else np.zeros(0, np.uint64)
        out.append(mix(tokens[same]) * _U(3) + mix(tokens[same + step] + _U(1)))
        step += 1


def keys_of(s: Sets, which: np.ndarray, slots: np.ndarray, coarse: np.ndarray, n: int):
    """Keys of some sets: (key, document, whether the document's prefix has pairs)."""
    use = np.zeros(len(s.size), bool)
    use[which] = True
    at = np.flatnonzero(use[s.doc])
    token, doc = s.token[at], s.doc[at]
    often = _is_frequent(token, slots, coarse, n)
    level = np.log2(np.maximum(s.size, 1)).astype(np.int64)
    need = prefix_size(s.size)
    rank = np.arange(len(token)) - np.searchsorted(doc, doc)
    plain = (level[doc] <= 3) & (rank < need[doc])  # the scheme of small sets: all tokens alike
    rare = np.flatnonzero(~often & (level[doc] >= 3))
    rank = np.arange(len(rare)) - np.searchsorted(doc[rare], doc[rare])
    rare = rare[rank < need[doc[rare]]]
    held = np.bincount(doc[rare], minlength=len(s.size))
    open_ = use & (level >= 3) & (held < need)
    keys = [mix(token[plain] ^ _U(0x5555)), token[rare]]
    docs = [doc[plain], doc[rare]]
    for d in np.flatnonzero(open_).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        mine = token[a:b][often[a:b]]
        for at_level in {max(int(level[d]), 4), int(level[d]) + 1}:
            more = pair_keys(mine, int(need[d] - held[d]), 1 << (at_level - 3))
            keys.append(more)
            docs.append(np.full(len(more), d))
    return np.concatenate(keys), np.concatenate(docs), open_


def _pairs(key, sig, size, paired):
    """Candidate pairs from entries of one partition: (a, b, bound short by, exempt)."""
    order = np.lexsort((sig, key))
    key, sig, size, paired = key[order], sig[order], size[order], paired[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]) if len(key) else np.zeros(0, bool)
    key, sig, size, paired = key[new], sig[new], size[new], paired[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate([begin, [len(key)]]))
    hot = np.repeat(run > BUCKET, run)
    left = np.repeat(np.arange(len(run)), run)
    star = np.flatnonzero(hot)
    a, b = [begin[left[star]]], [star]
    exempt = [np.ones(len(star), bool)]
    cool = np.flatnonzero(~hot & np.repeat(run > 1, run))
    last = (begin + run)[left[cool]]
    step = 1
    while len(cool):
        inside = cool + step < last
        cool, last = cool[inside], last[inside]
        fits = 4 * np.minimum(size[cool], size[cool + step]) >= 3 * np.maximum(size[cool], size[cool + step])
        a.append(cool[fits])
        b.append(cool[fits] + step)
        exempt.append(paired[cool[fits]] | paired[cool[fits] + step])
        step += 1
    a, b, exempt = np.concatenate(a), np.concatenate(b), np.concatenate(exempt)
    use = sig[a] != sig[b]
    return sig[a[use]], sig[b[use]], size[a[use]], size[b[use]], exempt[use]


def _loose_edges(docs: DataFrame, n: int) -> DataFrame:
    """Edges between sets that may be similar, a spanning forest of them for each task."""
    spark = docs.sparkSession
    slots = _frequent(docs, n)
    coarse = np.zeros(1 << 24, bool)
    coarse[(slots >> _U(40)).astype(np.int64)] = True
    known = spark.sparkContext.broadcast((slots, np.packbits(coarse)))

    def emit(batches):
        slots, bits = known.value
        coarse = np.unpackbits(bits).astype(bool)
        for s in _sets(batches):
            key, doc, paired = keys_of(s, s.distinct(), slots, coarse, n)
            order = np.lexsort((doc, (key % _U(n)).astype(np.uint16 if n <= 65536 else np.uint32)))
            key, doc = key[order], doc[order]
            ends = np.searchsorted((key % _U(n)).astype(np.int64), np.arange(n + 1))
            meta = (s.size[doc] * 2 + paired[doc]).astype("<u4")
            full = np.flatnonzero(np.diff(ends))
            yield packed(full.tolist(), [_write(key[ends[p] : ends[p + 1]], s.sig[doc[ends[p] : ends[p + 1]]], meta[ends[p] : ends[p + 1]]) for p in full])

    def meet(batches):
        parts = [_read(x, "<u8", "<u8", "<u4") for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        key, sig, meta = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b, size_a, size_b, exempt = _pairs(key, sig, (meta >> 1).astype(np.int64), (meta & 1).astype(bool))
        order, ends = cut((mix(a) % _U(n)).astype(np.int64), n)
        a, b, meta_a, meta_b = a[order], b[order], size_a[order].astype("<u4"), (size_b * 2 + exempt)[order].astype("<u4")
        full = np.flatnonzero(np.diff(ends))
        yield packed(full.tolist(), [_write(*(x[ends[p] : ends[p + 1]] for x in (a, b, meta_a, meta_b))) for p in full])

    def prune(batches):
        parts = [_read(x, "<u8", "<u8", "<u4", "<u4") for batch in batches for x in batch.column("blob").to_pylist()]
        if not parts:
            return
        a, b, size_a, size_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        exempt, size_a, size_b = size_b & 1 > 0, size_a.astype(np.int64), (size_b >> 1).astype(np.int64)
        order = np.lexsort((b, a))
        a, b, size_a, size_b, exempt = (x[order] for x in (a, b, size_a, size_b, exempt))
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        if not len(begin):
            return
        met = np.diff(np.concatenate([begin, [len(a)]]))
        free = np.maximum.reduceat(exempt, begin)
        a, b, size_a, size_b = a[begin], b[begin], size_a[begin], size_b[begin]
        rest = np.maximum(size_a - prefix_size(size_a), size_b - prefix_size(size_b))
        keep = free | (met + rest >= overlap(size_a, size_b))
        yield _forest(a[keep], b[keep])

    met = deal(docs.mapInArrow(task(emit), PACKED), n).mapInArrow(task(meet), PACKED)
    return deal(met, n).mapInArrow(task(prune), "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A star for each component of these edges, as edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = find_roots(at[: len(a)], at[len(a) :], len(nodes))
    use = root != np.arange(len(nodes))
    return pa.record_batch([pa.array(nodes[use].astype(np.uint64).view(np.int64)), pa.array(nodes[root[use]].astype(np.uint64).view(np.int64))], ["a", "b"])


def similar(tokens: list[np.ndarray], left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with similarity 0.75 or more; with ``left``, only pairs across it."""
    size = np.array([len(t) for t in tokens])
    every, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), size)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    use = times[column] > 1
    column, owner = column[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(tokens), len(tokens)), np.float32 if size.max(initial=0) < 1 << 24 else np.float64)
    wide = max(1024, 8_000_000 // len(tokens))
    dense = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    for a in range(0, int(dense[-1]) + 1 if len(dense) else 0, wide):
        low, high = np.searchsorted(dense, [a, a + wide])
        part = np.zeros((len(tokens), min(wide, int(dense[high - 1]) - a + 1)), common.dtype)
        part[owner[low:high], dense[low:high] - a] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    link = np.triu(100 * common.astype(np.float64) >= 75 * union, 1)
    if left is not None:
        link &= left[:, None] != left[None, :]
    return np.nonzero(link)


def _compared(pair: bytes, members: list[bytes]) -> pa.RecordBatch | None:
    """The links of one task, whose members are (side, name, set, tokens): all of them (whole group), or those between
    its two sides; with pivots, also which of them each set is linked to."""
    _, _, kind = np.frombuffer(pair, "<i8")
    side, names, sets = (np.array([np.frombuffer(m, "<i8", 1, at)[0] for m in members]) for at in (0, 8, 16))
    a, b = similar([np.frombuffer(m, "<u8", -1, 24) for m in members], None if kind == WHOLE else side >= 0) if len(members) > 1 else ([], [])
    if not len(a):
        return None
    forest = _forest(names.view(np.uint64)[a], names.view(np.uint64)[b])
    node, mask = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if kind == PIVOTED:
        pivot, set_ = np.where(side[a] >= 0, a, b), np.where(side[a] >= 0, b, a)
        of = np.zeros(len(members), np.int64)
        np.bitwise_or.at(of, set_, np.int64(1) << side[pivot])
        node, mask = sets[of > 0], of[of > 0]
    more, less = pa.nulls(len(node), pa.int64()), pa.nulls(forest.num_rows, pa.int64())
    columns = [(forest.column("a"), more), (forest.column("b"), more), (less, pa.array(node)), (less, pa.array(mask))]
    return pa.record_batch([pa.concat_arrays(c) for c in columns], ["a", "b", "node", "mask"])


def _met(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Links in all tasks of ``places``: a row (node, low, component, i, j, side) puts a set into task (component, i, j)."""
    spark = docs.sparkSession
    bits = places.select(F.pmod(F.shiftrightunsigned("node", 8), F.lit(FILTER_BITS)).alias("bit")).select((F.col("bit") / 8).cast("int").alias("at"), F.pmod("bit", F.lit(8)).cast("int").alias("by")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, by)")).alias("mask"))

    def region(batches):
        for batch in batches:
            at, mask = np.asarray(batch.column("at")), np.asarray(batch.column("mask")).astype(np.uint8)
            yield pa.record_batch([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())], ["at", "mask"])

    filter_ = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.mapInArrow(task(region), "at binary, mask binary").collect():  # at most FILTER_BITS / 8 places together
        filter_[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["mask"], np.uint8)
    wanted = spark.sparkContext.broadcast(filter_)
    fields = ["node", "low", "component", "i", "j", "side"]
    schema = "pid int, blob binary, " + ", ".join(f"{f} long" for f in fields)

    def ship(batches):
        flags = wanted.value
        for s in _sets(batches):
            which = s.distinct()
            bit = (s.sig[which] >> _U(8)) % _U(FILTER_BITS)
            which = which[(flags[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0]
            pid = (mix(s.sig[which]) % _U(n)).tolist()
            blobs = [s.sig[d].tobytes() + s.token[s.first[d] : s.first[d + 1]].tobytes() for d in which.tolist()]
            for at in range(0, len(blobs), 2000):
                part = slice(at, at + 2000)
                yield pa.record_batch([pa.array(pid[part], pa.int32()), pa.array(blobs[part], pa.binary()), *(pa.nulls(len(blobs[part]), pa.int64()) for _ in fields)], ["pid", "blob", *fields])

    def place(batches):
        for batch in batches:
            pid = (mix(np.asarray(batch.column("node")).view(np.uint64)) % _U(n)).astype(np.int32)
            yield pa.record_batch([pa.array(pid), pa.nulls(batch.num_rows, pa.binary()), *(batch.column(f) for f in fields)], ["pid", "blob", *fields])

    def assign(batches):
        """Each set to the tasks that it takes part in."""
        held: dict[int, bytes] = {}
        asked: list[np.ndarray] = []
        for batch in batches:
            sent = batch.column("blob")
            for blob in sent.drop_null().to_pylist():
                held[int(np.frombuffer(blob, "<i8", 1)[0])] = blob
            asked.append(np.column_stack([np.asarray(batch.filter(sent.is_null()).column(f)) for f in fields]))
        rows = np.concatenate(asked) if asked else np.zeros((0, len(fields)), np.int64)
        key = np.ascontiguousarray(rows[:, 2:5]).view(np.uint64)
        pids = (mix(key[:, 0] + mix(key[:, 1] + mix(key[:, 2]))) % _U(n)).tolist()
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            blobs = [np.array([side, low], "<i8").tobytes() + held[node] for node, low, side in part[:, [0, 1, 5]].tolist()]
            yield pa.record_batch([pa.array(pids[at : at + 1000], pa.int32()), pa.array([k.tobytes() for k in part[:, 2:5].astype("<i8")], pa.binary()), pa.array(blobs, pa.binary())], ["pid", "task", "blob"])

    def compare(batches):
        """Tasks one after another, as they come sorted."""
        now, members = b"", []
        for batch in batches:
            for pair, blob in zip(batch.column("task").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if pair != now:
                    if members and (found := _compared(now, members)) is not None:
                        yield found
                    now, members = pair, []
                members.append(blob)
        if members and (found := _compared(now, members)) is not None:
            yield found

    rows = docs.mapInArrow(task(ship), schema).unionByName(places.mapInArrow(task(place), schema))
    assigned = deal(rows, n).mapInArrow(task(assign), "pid int, task binary, blob binary")
    return deal(assigned, n).sortWithinPartitions("task").select("task", "blob").mapInArrow(task(compare), "a long, b long, node long, mask long")


def _main_pivots(masks):
    """Of one group's masks with their counts: the pivots that hang together and have the most sets."""
    whole = {}
    for mask, count in zip(masks["mask"], masks["count"], strict=True):
        mask, count = int(mask), int(count)
        for other in [x for x in whole if x & mask]:
            count += whole.pop(other)
            mask |= other
        whole[mask] = whole.get(mask, 0) + count
    best = max(whole, key=lambda x: (whole[x], x))
    return masks.iloc[:1][["component"]].assign(pivots=best)


def _links(docs: DataFrame, loose: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Edges of true similarity inside the loose groups, a spanning forest of them for each task.

    A group of at most GROUP_BLOCK sets is one task.  In a larger one all sets first meet up to PIVOTS of their
    own; sets that hang together through pivots need no further look at each other, so only the others are then
    compared with everyone, block by block.  A group of near-copies costs its size, not its square.  Ends of edges
    are the sets' smallest documents, so that components of them need no second naming.
    """
    sized = loose.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / GROUP_BLOCK).cast("long")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    nodes = shared(loose.join(sized, "component").join(sets, F.col("node") == F.col("sig")).select("node", "component", blocks.alias("blocks"), "low").withColumn("block", block))
    at = lambda i, j, side: (F.lit(i).cast("long").alias("i") if isinstance(i, int) else i.alias("i"), F.lit(j).cast("long").alias("j") if isinstance(j, int) else j.alias("j"), F.lit(side).cast("long").alias("side") if isinstance(side, int) else side.alias("side"))
    whole = nodes.where("blocks = 1").select("node", "low", "component", *at(0, WHOLE, 0))
    large = nodes.where("blocks > 1")
    if not large.limit(1).count():
        return _met(docs, whole, n).select("a", "b").where("a IS NOT NULL")
    pivots = large.where(F.col("block") < PIVOTS).groupBy("component", "block", "blocks").agg(F.min(F.struct("node", "low")).alias("p"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = large.select("node", "low", "component", *at(F.col("block"), PIVOTED, -1)).unionByName(
        pivots.select("p.node", "p.low", "component", "block", every.alias("i")).select("node", "low", "component", *at(F.col("i"), PIVOTED, F.col("block")))
    )
    met = shared(_met(docs, first.unionByName(whole), n))
    masks = met.where("node IS NOT NULL").select("node", "mask")
    grouped = large.join(masks, "node", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    main = grouped.groupBy("component", "mask").count().where("mask <> 0").groupBy("component").applyInPandas(_main_pivots, "component long, pivots long")
    rest = shared(grouped.join(main, "component", "left").withColumn("alone", F.col("mask").bitwiseAND(F.coalesce("pivots", F.lit(0))) == 0))
    others = rest.where("alone").groupBy("component").agg(F.count(F.lit(1)).alias("others"))
    parts = F.ceil(F.col("others") / GROUP_BLOCK).cast("long")
    asked = rest.join(others, "component").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("low"), parts))
    against = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    second = asked.select("node", "low", "component", "block", against.alias("j")).select("node", "low", "component", *at(F.col("block"), F.col("j"), -1)).unionByName(
        asked.where("alone").select("node", "low", "component", "part", every.alias("i")).select("node", "low", "component", *at(F.col("i"), F.col("part"), 0))
    )
    return met.select("a", "b").where("a IS NOT NULL").unionByName(_met(docs, second, n).select("a", "b").where("a IS NOT NULL"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, its own included)."""
    n = partitions(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    members = shared(memberships(docs))
    loose = components(_loose_edges(docs, n))
    full = members.where("n_shingles > 0")
    sets = full.groupBy("sig").agg(F.min("doc_id").alias("low"))
    linked = components(_links(docs, loose, sets, n))
    of_set = sets.join(linked, F.col("low") == F.col("node"), "left").select("sig", F.coalesce("component", "low").alias("component_id"))
    out = full.join(of_set, "sig").select("doc_id", "n_shingles", "component_id").union(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id")))
    return out.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: each class keeps its smallest doc_id."""
    gone = shared(classes(docs).where("NOT doc_id <=> component_id").select("doc_id"))
    return without(docs, gone, "doc_id")


def oracle() -> str:
    """DuckDB SQL for ``classes`` (doc_id unique)."""
    return """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a node, a low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(low) low FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT n_shingles, coalesce(low, w.doc_id)::BIGINT component_id FROM w LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""


