"""Substring dedup over words by compaction of a de Bruijn graph.

Edges are token k-mers: the windows of ``LENGTH`` words.  An edge leads from the node of its first ``LENGTH - 1``
words to the node of its last, so edges that follow each other in a document meet in a node.  Only edges under an
anchor that occurs again are looked at; where an anchor's surroundings never branch, the edges around it travel
as one block, elsewhere one by one.  What starts earlier elsewhere is a repeated run of edges with its source.

Repeated runs compact through Spark joins: the nodes where runs along one source begin are joined with the nodes
where such runs end, and a node that is both (one run leads in, one out) vanishes.  The nodes that are left, begin
or end the paths.  Each path then carries source coordinates, and these verify it: the words at both places are
brought from the texts, and only a path whose words have the same 128-bit digest as its source's takes words away.

Words are maximal runs without white space, unchanged; a window lies in one document.  A word goes if a
window over it has its sequence of words starting earlier (smaller doc_id, or same document, earlier
start).  Windows are judged on the input.

Nulls and edge cases: a null or empty text has no words and keeps the empty string; a null doc_id orders
before all others; rows that repeat a doc_id with the same text are one document and get equal results;
different texts under one doc_id are documents of their own, ordered by a hash of the text; empty tables give
no rows; other columns pass through ``drop_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import PACKED, bit_filter, flat, id_array, ids_of, packed, shared, task, word_hashes, words_of
from .repeats import KEY, Units, covered, filters, findings, keyed, partitions, read_findings, union_of, with_texts

LENGTH, GRAM = 20, 8
RUNS = "doc long, source long, shift long, first long, last long"
SIGNED = "doc long, doc_id long, start long, n_words long, source long, source_start long, d1 long, d2 long"
_ALONG = ["doc", "source", "shift"]


def _symbols(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, first = words_of(buf, offsets)
    return word_hashes(buf, starts, ends), first


UNITS = Units(_symbols, LENGTH, GRAM, 1 << 20)


def _runs(batches):
    """Rows of repeated runs: their first and last node, and how far on the source stands."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            doc, start, end, source, source_start = read_findings(blob)
            columns = (doc, source, source_start - start, start, end - (LENGTH - 1))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc", "source", "shift", "first", "last"])


def compacted(runs: DataFrame) -> DataFrame:
    """(doc, start, n_words, source, source_start): maximal paths of repeated runs along one source."""
    begin = runs.select(*_ALONG, F.col("first").alias("node")).groupBy(*_ALONG, "node").agg(F.count(F.lit(1)).alias("leads_out"))
    end = runs.select(*_ALONG, F.col("last").alias("node")).groupBy(*_ALONG, "node").agg(F.count(F.lit(1)).alias("leads_in"))
    step = F.coalesce("leads_out", F.lit(0)) - F.coalesce("leads_in", F.lit(0))
    left = begin.join(end, [*_ALONG, "node"], "full_outer").withColumn("step", step).where("step <> 0")
    order = Window.partitionBy(*_ALONG).orderBy("node")
    depth = F.sum("step").over(order)  # runs of copied rows may overlap; most nodes here have depth 1 or 0
    ends = left.withColumn("depth", depth).where("depth = 0 OR depth = step").withColumn("stop", F.lead("node").over(order)).where("depth <> 0")
    return ends.select("doc", F.col("node").alias("start"), (F.col("stop") - F.col("node") + LENGTH - 1).alias("n_words"), "source", (F.col("node") + F.col("shift")).alias("source_start"))


def _packed_claims(n: int):
    def run(batches):
        for batch in batches:
            doc, start, size, source, source_start = (np.asarray(batch.column(c)) for c in ("doc", "start", "n_words", "source", "source_start"))
            rows = list(findings(doc, start, start + size, source, source_start, n, join=False))
            yield packed([p for p, _ in rows], [x for _, x in rows])

    return run


def _signed(batch, ranges):
    """Digests of the words at all places that are asked for in these texts."""
    buf, offsets = flat(batch.column("text"))
    starts, ends, first = words_of(buf, offsets)
    raw, rows = buf.tobytes(), []
    for key, doc, base in zip(ids_of(batch, KEY).tolist(), ids_of(batch).tolist(), first[:-1].tolist(), strict=True):
        for a, b, source, source_start in zip(*(c.tolist() for c in ranges(key)), strict=True):
            words = b" ".join([raw[s:e] for s, e in zip(starts[base + a : base + b].tolist(), ends[base + a : base + b].tolist(), strict=True)])
            rows.append((key, doc, a, b - a, source, source_start, *struct.unpack("<2q", hashlib.blake2b(words, digest_size=16).digest())))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    arrays = [pa.array(columns[0], pa.int64()), id_array(np.array(columns[1], np.int64)), *(pa.array(c, pa.int64()) for c in columns[2:])]
    return pa.record_batch(arrays, ["doc", "doc_id", "start", "n_words", "source", "source_start", "d1", "d2"])


def _verified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Paths whose words stand at their source's coordinates too, all paths, and their digests (``docs`` has KEY)."""
    n = partitions(docs.sparkSession)
    found = shared(covered(docs, UNITS, filters(docs, UNITS, n)))  # read for both ends of the runs
    paths = shared(compacted(found.mapInArrow(_runs, RUNS)))
    sources = paths.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n_words").distinct()  # many copies ask for one place
    asked = paths.unionByName(sources.select("doc", "start", "n_words", F.col("doc").alias("source"), F.lit(-1).cast("long").alias("source_start")))
    wanted = bit_filter(paths.select("doc").union(paths.select("source")))
    signed = shared(with_texts(docs.select(KEY, "doc_id", "text"), asked.mapInArrow(task(_packed_claims(n)), PACKED), n, _signed, SIGNED, wanted, others=False))
    claims = signed.where("source_start >= 0")
    at = F.when(F.col("source_start") < 0, F.col("start")).otherwise(F.col("source_start"))
    alike = [F.min(c) == F.max(c) for c in ("d1", "d2")]  # all copies of a place at once, summed up before they meet
    odd = signed.groupBy("source", at.alias("at"), "n_words").agg((alike[0] & alike[1] & (F.min("source_start") < 0)).alias("alike")).where("NOT alike")
    if odd.limit(1).count():  # names of different words that collide; each claim is held against its source
        claims = claims.join(_sources(signed), ["source", "source_start", "n_words", "d1", "d2"], "left_semi")
    return claims, paths, signed, n


def _sources(signed: DataFrame) -> DataFrame:
    """Digests and doc_ids at the sources' coordinates; rows may repeat in the texts."""
    place = [F.col("doc").alias("source"), F.col("start").alias("source_start"), "n_words", "d1", "d2", F.col("doc_id").alias("source_doc")]
    return signed.where("source_start < 0").select(*place).distinct()


def paths(docs: DataFrame) -> DataFrame:
    """Verified paths: doc_id, start and words of each, and where its words stand first."""
    verified, _, signed, _ = _verified(keyed(docs.select("doc_id", "text")))
    named = verified.join(_sources(signed), ["source", "source_start", "n_words", "d1", "d2"])
    return named.select("doc_id", "start", "n_words", "source_doc", "source_start").distinct()


def _finished(docs: DataFrame, finish, schema) -> DataFrame:
    """``finish`` on all documents with their verified paths; a document without a path stays where it is read."""
    verified, paths, _, n = _verified(docs)
    return with_texts(docs, verified.mapInArrow(task(_packed_claims(n)), PACKED), n, finish, schema, bit_filter(paths.select("doc")))


def _kept(batch, ranges):
    """Per row: words, words removed, and the kept words joined by one space."""
    buf, offsets = flat(batch.column("text"))
    starts, ends, first = words_of(buf, offsets)
    raw = buf.tobytes()
    for i, doc in enumerate(ids_of(batch, KEY).tolist()):
        a, b = int(first[i]), int(first[i + 1])
        low, high = union_of(*ranges(doc)[:2])
        keep = np.ones(b - a, bool)
        for s, e in zip(low.tolist(), high.tolist(), strict=True):
            keep[s:e] = False
        at = a + np.flatnonzero(keep)
        yield b - a, b - a - len(at), b" ".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])


def digest(docs: DataFrame) -> DataFrame:
    docs = keyed(docs.select("doc_id", "text"))

    def finish(batch, ranges):
        rows = [(w, r, hashlib.sha256(kept).hexdigest()) for w, r, kept in _kept(batch, ranges)]
        words, removed, sha = zip(*rows, strict=True)
        return pa.record_batch([id_array(ids_of(batch)), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _finished(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The same rows; the text of documents that lose words is what is left, joined by one space."""
    schema, docs = docs.schema, keyed(docs)

    def finish(batch, ranges):
        texts = batch.column("text")
        new = [kept.decode("utf-8", "replace") if removed else None for _, removed, kept in _kept(batch, ranges)]
        same = pa.array([t is None for t in new])
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pc.if_else(same, texts, pa.array(new, texts.type))).drop_columns([KEY])

    return _finished(docs, finish, schema)


def oracle() -> str:
    """DuckDB SQL for ``digest`` (doc_id unique)."""
    return f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {LENGTH - 1}], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) i FROM w WHERE len(w) >= {LENGTH})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j i FROM late, range({LENGTH}) t(j)),
word AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) s, count(*) n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(s, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


