"""Embedding near-dedup by iterative quantisation, multi-index Hamming tables and exact reranking.

A rotation of the principal axes is learnt on a bounded sample (``SAMPLE`` distinct vectors, smallest
hashes first) so that signs make balanced codes of up to 64 bits.  Each table indexes one substring of the
code, cut from it after a fixed shuffle of its bits; there are as many tables as a substring has bits, eight at
least, and substrings get longer as labels get fuller.  At the threshold a bit differs with probability 0.064, so
a pair fails to meet in all tables about once in a thousand.  Only identities and codes go through the tables.
Who meets a code no further than ``reach`` bits away, under the first table where the two meet, has its vector
fetched into that bucket once, and there vectors are compared by cosine in double precision.

Equal vectors of a label are one class from the start; a bucket with more than ``BUCKET_BLOCK`` members (more,
where over a million buckets would be so full) is dealt to several tasks and its questions go to each of them.
No member or pair of a bucket is dropped or capped.

Nulls and edge cases: vectors without a label, null, empty, zero, or with a null or non-finite component
link with nothing; vectors of different lengths are not compared; rows that repeat are copies and link with
one another; a null vec_id links like any other but never names a component others read (it orders before
all and comes back as null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import BROADCAST_ROWS, components
from .jaccard import _forest
from .kernels import NULL_ID, PACKED, cut, deal, mix, packed, partitions, shared, task

THRESHOLD = 0.98
SAMPLE, ROUNDS = 20_000, 40
TABLES = 8  # at least
BUCKET_MEMBERS, BUCKET_BLOCK = 32, 512
WIDEST = 28  # bits of a substring
QUESTIONS = 128  # vectors compared with a bucket at a time
VECTOR = bytes(16) + b"vector"  # begins the row of a vector; a list of entries begins with a bucket's key
_U = np.uint64


def learn_rotation(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimensions by bits) of iterative quantisation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(0)
    x = unit - centre
    bits = min(64, x.shape[1])
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return centre, axes @ rotation


def codes(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = (unit - centre) @ projection >= 0
    return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def layout(bits: int, fullest: int) -> list[int]:
    """Tables as masks over codes: wide enough for about BUCKET_MEMBERS a bucket, at most half the bits."""
    width = int(np.clip(np.ceil(np.log2(max(fullest / BUCKET_MEMBERS, 2))), 4, WIDEST))
    width = max(1, min(width, bits // 2))
    shuffle = np.random.default_rng(11)
    order = np.concatenate([shuffle.permutation(bits)[: bits // width * width] for _ in range(max(TABLES, width))])
    return [sum(1 << int(b) for b in order[t * width : (t + 1) * width]) for t in range(max(TABLES, width))]


def reach(bits: int, threshold: float = THRESHOLD) -> int:
    """Bits that codes of vectors at the threshold may differ in: the mean and six standard deviations."""
    p = float(np.arccos(threshold) / np.pi)
    return int(np.ceil(bits * p + 6 * np.sqrt(bits * p * (1 - p))))


def _valid(v: str, label: str):
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & F.col(v).isNotNull() & fine & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, each row scaled by its largest component."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)


def _rows(column) -> np.ndarray:
    """Rows of equal length as they are stored, in single precision where the column is."""
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(values, np.float32 if pa.types.is_float32(values.type) else np.float64).reshape(len(column), -1)


def _by_length(batch):
    """Row numbers of a batch by vector length."""
    lengths = np.asarray(batch.column("v").value_lengths())
    return [(int(d), np.flatnonzero(lengths == d)) for d in np.unique(lengths)]


def classes(vectors: DataFrame, label: str = "label", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (others linked directly), component_id and kept, one row per vector."""
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(label).cast("string").alias("l"), F.col(vector).alias("v")).withColumn("ok", _valid("v", "l"))
    named = rows.withColumns({"k1": F.xxhash64(F.lit(1), "l", "v"), "k2": F.xxhash64(F.lit(2), "v", "l")})
    members = shared(named.select("vec_id", "ok", "k1", "k2"))
    distinct = shared(named.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.any_value("l").alias("l"), F.any_value("v").alias("v")))
    groups = distinct.groupBy("l", F.size("v").alias("d")).count()
    sizes = {r.d: r.n for r in groups.groupBy("d").agg(F.max("count").alias("n")).collect()}  # a few lengths
    models = {}
    for d in sizes:
        sample = distinct.where(F.size("v") == d).orderBy(F.xxhash64("rep"), "k1").limit(SAMPLE).select("v").toArrow()
        centre, projection = learn_rotation(_scaled(_rows(sample.column("v"))))
        bits = projection.shape[1]
        models[d] = centre, projection, [_U(m) for m in layout(bits, sizes[d])], reach(bits, threshold)

    def keys(code: np.ndarray, label_hash: np.ndarray, d: int, t: int, mask: np.uint64) -> np.ndarray:
        return mix(mix(label_hash + _U(d * 64 + t)) ^ (code & mask))

    def located(batches):
        """By batch and length: where its rows stand, their raw vectors, codes and hashed labels."""
        for batch in batches:
            label_hash = np.asarray(batch.column("lh")).view(np.uint64)
            for d, at in _by_length(batch):
                raw = _rows(batch.column("v").take(pa.array(at)))
                yield batch, d, at, raw, codes(_scaled(raw), *models[d][:2]), label_hash[at]

    def counted(batches):
        for _, d, _, _, code, lh in located(batches):
            for t, mask in enumerate(models[d][2]):
                key, count = np.unique(keys(code, lh, d, t, mask), return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(count, pa.int64())], ["key", "n"])

    source = distinct.select("rep", "w", F.xxhash64("l").alias("lh"), "v")
    heavy = shared(source.mapInArrow(task(counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET_BLOCK))
    block = BUCKET_BLOCK
    while heavy.where(F.col("n") > block).count() > BROADCAST_ROWS:  # keeps the table of split buckets small
        block *= 2
    hot = heavy.where(F.col("n") > block).toArrow()
    hot_key = np.asarray(hot.column("key")).view(np.uint64)
    order = np.argsort(hot_key)
    hot_key, hot_parts = hot_key[order], -(-np.asarray(hot.column("n"))[order] // block)

    def parts_of(key: np.ndarray) -> np.ndarray:
        if not len(hot_key):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
        return np.where(hot_key[at] == key, hot_parts[at], 1)

    entry = np.dtype([("key", "<u8"), ("rep", "<i8"), ("code", "<u8"), ("part", "<i4"), ("d", "<i4"), ("t", "<i2"), ("kind", "<i2")])

    def by_part(rows: np.ndarray, pid: np.ndarray):
        order, ends = cut(pid, n)
        full = np.flatnonzero(np.diff(ends)).tolist()
        return packed(full, [rows[order[ends[p] : ends[p + 1]]].tobytes() for p in full])

    def bucket(rows: np.ndarray) -> np.ndarray:
        return (mix(rows["key"] + rows["part"].astype(np.uint64) * _U(31)) % _U(n)).astype(np.int64)

    def home(rep: np.ndarray) -> np.ndarray:
        return (mix(np.ascontiguousarray(rep).view(np.uint64) + _U(5)) % _U(n)).astype(np.int64)

    def index(batches):
        """Identities and codes to their buckets: members (kind 0), and what they ask the bucket's other parts (1)."""
        for batch, d, at, _, code, lh in located(batches):
            rep = np.asarray(batch.column("rep"))[at]
            for t, mask in enumerate(models[d][2]):
                key = keys(code, lh, d, t, mask)
                many = parts_of(key)
                own = (mix(rep.view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                i = np.repeat(np.arange(len(at)), many)
                rows = np.zeros(len(i), entry)
                rows["part"] = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                rows["key"], rows["rep"], rows["code"], rows["d"], rows["t"], rows["kind"] = key[i], rep[i], code[i], d, t, rows["part"] != own[i]
                yield by_part(rows, bucket(rows))

    def groups(h: np.ndarray):
        """(from, to, members) of each bucket part in sorted entries, where two can meet."""
        if not len(h):
            return
        begin = np.flatnonzero(np.concatenate([[True], (h["key"][1:] != h["key"][:-1]) | (h["part"][1:] != h["part"][:-1])]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True):
            members = int((h["kind"][a:b] == 0).sum())
            if members and b - a > 1:
                yield a, b, members

    def near(g: np.ndarray, q: slice, members: int) -> np.ndarray:
        """Which members a block of askers meets here first, within reach."""
        _, _, masks, most = models[int(g["d"][0])]
        apart = g["code"][q][:, None] ^ g["code"][None, :members]
        use = (np.bitwise_count(apart) <= most) & (g["rep"][q][:, None] != g["rep"][None, :members])
        for mask in masks[: int(g["t"][0])]:  # met before under an earlier table
            use &= (apart & mask) != 0
        return use

    def screen(batches):
        """Who needs its vector in which bucket, by identity."""
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        h = np.frombuffer(b"".join(blobs), entry)
        h = h[np.lexsort((h["rep"], h["kind"], h["part"], h["key"]))]
        needed = np.zeros(len(h), bool)
        for a, b, members in groups(h):
            for low in range(0, b - a, QUESTIONS):
                q = slice(low, min(b - a, low + QUESTIONS))
                use = near(h[a:b], q, members)
                needed[a + q.start : a + q.stop] |= use.any(1)
                needed[a : a + members] |= use.any(0)
        rows = h[needed]
        yield by_part(rows, home(rows["rep"]))

    def vectors_home(batches):
        """Vectors by identity, once."""
        for batch, d, at, raw, _, _ in located(batches):
            rep, w = np.asarray(batch.column("rep"))[at], np.asarray(batch.column("w"))[at]
            pids = home(rep).tolist()
            blobs = [VECTOR + np.array([r, k, d], "<i8").tobytes() + v.tobytes() for r, k, v in zip(rep.tolist(), w.tolist(), raw, strict=True)]
            for a in range(0, len(blobs), 5000):
                yield packed(pids[a : a + 5000], blobs[a : a + 5000])

    def fetch(batches):
        """Each needed vector to the buckets that need it."""
        held: dict[int, bytes] = {}
        asked = []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                if blob.startswith(VECTOR):
                    held[int(np.frombuffer(blob, "<i8", 1, len(VECTOR))[0])] = blob[len(VECTOR) + 8 :]
                else:
                    asked.append(blob)
        rows = np.frombuffer(b"".join(asked), entry)
        pids = bucket(rows).tolist()
        for a in range(0, len(rows), 2000):
            part = slice(a, a + 2000)
            yield packed(pids[part], [row.tobytes() + held[int(row["rep"])] for row in rows[part]])

    def meet(batches):
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        h = np.frombuffer(b"".join(x[: entry.itemsize] for x in blobs), entry)
        order = np.lexsort((h["rep"], h["kind"], h["part"], h["key"]))
        h = h[order]
        for a, b, members in groups(h):
            g, d = h[a:b], int(h["d"][a])
            rows = [blobs[i][entry.itemsize :] for i in order[a:b].tolist()]
            w = np.array([np.frombuffer(x, "<i8", 1)[0] for x in rows])
            kind = "<f4" if len(rows[0]) == 16 + 4 * d else "<f8"
            x = _scaled(np.frombuffer(b"".join(x[16:] for x in rows), kind).reshape(b - a, d))
            norm = np.linalg.norm(x, axis=1)
            for low in range(0, b - a, QUESTIONS):
                q = slice(low, min(b - a, low + QUESTIONS))
                link = (x[q] @ x[:members].T) / (norm[q, None] * norm[None, :members]) >= threshold
                i, j = np.nonzero(link & near(g, q, members))
                if len(i):
                    asking = g["rep"][q][i]
                    who, at = np.unique(asking, return_inverse=True)
                    star = _forest(asking.view(np.uint64), g["rep"][:members][j].view(np.uint64))
                    found = np.bincount(at, w[:members][j]).astype(np.int64)
                    yield pa.record_batch([pa.array(who), pa.array(found), pa.nulls(len(who), pa.int64())], ["a", "n", "b"])
                    yield pa.record_batch([star.column("a"), pa.nulls(star.num_rows, pa.int64()), star.column("b")], ["a", "n", "b"])

    needs = deal(source.mapInArrow(task(index), PACKED), n).mapInArrow(task(screen), PACKED)
    fetched = deal(source.mapInArrow(task(vectors_home), PACKED).unionByName(needs), n).mapInArrow(task(fetch), PACKED)
    met = shared(deal(fetched, n).mapInArrow(task(meet), "a long, n long, b long"))
    links = met.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(met.where("b is not null").select("a", "b"))
    of_class = (
        distinct.select("k1", "k2", "rep", "w").join(links, F.col("rep") == F.col("a"), "left").join(linked, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    good = members.where("ok").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = members.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    null = lambda c: F.nullif(c, F.lit(NULL_ID)).alias(c)
    return good.union(bad).select(null("vec_id"), "n_links", null("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for ``classes`` over ``embeddings`` (vec_id unique)."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT a node, a low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(low) low FROM r GROUP BY node),
n AS (SELECT a, count(*) n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, coalesce(least(low, vec_id), vec_id)::BIGINT component_id, coalesce(least(low, vec_id), vec_id) = vec_id kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""
