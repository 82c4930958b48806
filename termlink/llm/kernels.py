"""Vectorised text kernels on Arrow batches, and the packed shuffle that the heavy operators share.

A kernel works on a block of whole texts (a few MB, or one longer text) as one byte array with
document offsets.  Word and window identities are 64-bit polynomial hashes over random symbol values,
finished with an avalanche step, so equal content has equal identity in every task and every run.

Packed shuffle: a task gathers fixed-width entries, cuts them by target partition and ships each cut
as one binary row (``pid``, ``blob``).  The JVM then moves thousands of rows instead of hundreds of
millions, while Spark still owns the exchange, its retries and its lost-executor recovery.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.stored import stored

NULL_ID = -(2**63)  # stands for a null doc_id inside a kernel
BLOCK_BYTES = 1 << 20  # working arrays take some sixty bytes for each byte of a block
PACKED = "pid int, blob binary"
FILTER_BITS = 1 << 26

_U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
_rng = np.random.Generator(np.random.PCG64(20240229))
SYMBOL = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = _U(0x9E3779B97F4A7C15 | 5)
BASE_INV = _U(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums that ``range_hash`` turns into the identity of any range."""
    out = np.empty(len(symbols) + 1, np.uint64)
    out[0] = 0
    np.cumsum(symbols * powers(len(symbols), BASE)[: len(symbols)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix), BASE_INV)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def task(run):
    """A batch function whose worker gives freed memory back when the task ends; workers serve many tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches, size: int = BLOCK_BYTES, text: str = "text"):
    """Slices of the incoming batches with about ``size`` bytes of text each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ids_of(batch, name: str = "doc_id") -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.cast(pa.int64()).fill_null(NULL_ID) if column.null_count else column.cast(pa.int64()))


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def words_of(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD):
    """Starts and ends of all words, and each document's first word (one more at the end)."""
    inside = table[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(SYMBOL[buf]), starts, ends)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1 .. (counts[0] of them), then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(pid: np.ndarray, n: int):
    """Order that brings entries of a partition together, and each partition's range in it."""
    order = np.argsort(pid.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    return order, np.searchsorted(pid[order], np.arange(n + 1))


def packed(pids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(pids, pa.int32()), pa.array(blobs, pa.binary())], ["pid", "blob"])


def deal(frame: DataFrame, n: int) -> DataFrame:
    """Brings all packed rows of a ``pid`` into one task; pid is the partition itself."""
    return frame.repartitionById(n, F.col("pid"))


def shared(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, in the folder that the cluster names."""
    return stored(frame)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits at the remainders of the one long column of ``keys``, FILTER_BITS of them whatever their number; a full
    filter says yes to everything."""
    bit = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS))
    bits = keys.select(F.floor(bit / 8).cast("int").alias("at"), F.pmod(bit, F.lit(8)).cast("int").alias("by")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, by)")).alias("mask"))

    def region(batches):
        for batch in batches:
            at, mask = np.asarray(batch.column("at")), np.asarray(batch.column("mask")).astype(np.uint8)
            yield pa.record_batch([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())], ["at", "mask"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.mapInArrow(task(region), "at binary, mask binary").collect():  # at most FILTER_BITS / 8 places together
        out[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["mask"], np.uint8)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys % FILTER_BITS
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
