"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The text's bytes are the symbols; the white-space marker is the space byte itself, and one is put
before a non-empty text.  Pieces have log scores; a character without a piece of its own costs the
lowest score less ``UNKNOWN_PENALTY`` and becomes its UTF-8 bytes (byte fallback), so decoding gives
every text back exactly, one that holds the marker character itself included.

No piece has a space after another character (checked on loading), so the best path passes through
every such place; the Viterbi runs over the distinct stretches between them, many at a time.

The vocabulary files here hold no unigram probabilities.  ``zipf_scores`` gives the pieces scores by
rule, from their rank; a real unigram model's scores go into ``Pieces`` the same way.

Nulls and edge cases: null text encodes to null (in the digest: no ids), empty text to no ids; a null
doc_id stays null; repeated rows give repeated rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import SYMBOL, flat, id_array, ids_of, prefix_hash, ragged, range_hash, task, text_blocks
from .packing import UnitIds

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
TOGETHER = 64  # stretches up to so many bytes are solved many at a time


def zipf_scores(n: int) -> np.ndarray:
    """Log probabilities of ranks 1..n under Zipf's law."""
    weights = 1.0 / np.arange(1, n + 1)
    return np.log(weights / weights.sum())


class DoubleArray:
    """Trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]) -> None:
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = -2  # the root; a base is at least 300 less a code
        order = sorted(range(len(keys)), key=keys.__getitem__)
        free, top, stack = 300, 300, [(0, 0, len(order), 0)]  # branching nodes go near the top, the others fill holes
        while stack:
            node, low, high, depth = stack.pop()
            if len(keys[order[low]]) == depth:
                self.value[node] = order[low]
                low += 1
            if low == high:
                continue
            children, at = [], low
            while at < high:
                c, to = keys[order[at]][depth], at
                while to < high and keys[order[to]][depth] == c:
                    to += 1
                children.append((c, at, to))
                at = to
            codes = np.array([c for c, _, _ in children]) + 1
            base = max(0, (free if len(codes) == 1 else max(free, top - 256)) - int(codes[0]))
            while True:
                if base + 300 > len(self.check):
                    more = len(self.check)
                    self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
                if (self.check[base + codes] == -1).all():
                    break
                base += 1
            self.base[node] = base
            self.check[base + codes] = node
            top = max(top, base + int(codes[-1]))
            while self.check[free] != -1:
                free += 1
            stack += [(int(base + c + 1), a, b, depth + 1) for c, a, b in children]
        self.check = np.concatenate([self.check, np.full(300, -1, np.int32)])

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[nodes] + codes + 1
        return to, self.check[to] == nodes


class Pieces:
    """A vocabulary: ids of text pieces with log scores, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[str], ids: list[int], scores: list[float], byte_ids: list[int]) -> None:
        self.keys = [p.replace(MARKER, " ").encode() for p in pieces]
        if any(b" " in k.lstrip(b" ") for k in self.keys):
            raise ValueError("a piece has a space after another character")
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores, np.float64)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(self.keys)
        out = {int(i): k for i, k in zip(ids, self.keys, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        self.bytes_of = [out.get(i, b"") for i in range(max(out) + 1)]
        self.width = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.cumsum(self.width) - self.width

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        everything = range(model.get_piece_size())
        byte_ids = [i for i in everything if model.is_byte(i)]
        text = [i for i in everything if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in text], text, zipf_scores(len(text)).tolist(), byte_ids)

    def _walk(self, text: bytes) -> list[int]:
        """Viterbi over one stretch; earlier starts win ties."""
        n = len(text)
        best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(n):
            if best[i] == -math.inf:
                continue
            wide = char_width(text, i)
            node, single = 0, False
            for j in range(i, n):
                to = int(base[node]) + text[j] + 1
                if check[to] != node:
                    break
                node = to
                if (v := int(value[node])) >= 0:
                    single |= j + 1 == i + wide
                    if (s := best[i] + float(self.scores[v])) > best[j + 1]:
                        best[j + 1], back[j + 1], via[j + 1] = s, i, v
            if not single and (s := best[i] + self.unknown) > best[i + wide]:
                best[i + wide], back[i + wide], via[i + wide] = s, i, -1
        out: list[int] = []
        while n:
            i = back[n]
            out += [int(self.ids[via[n]])] if via[n] >= 0 else [int(self.byte_ids[b]) for b in reversed(text[i:n])]
            n = i
        return out[::-1]

    def _together(self, texts: list[bytes]) -> list[list[int]]:
        """Viterbi over many short stretches, position by position."""
        count, longest = len(texts), max(map(len, texts))
        lengths = np.array([len(t) for t in texts])
        grid = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(count, longest).astype(np.int64)
        best = np.full((count, longest + 1), -np.inf)
        best[:, 0] = 0
        back, via = np.zeros((count, longest + 1), np.int16), np.full((count, longest + 1), -1, np.int32)
        wide = np.ones((count, longest), np.int64)
        for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            wide[grid >= lead] = size
        wide = np.minimum(wide, np.maximum(lengths[:, None] - np.arange(longest), 1))
        for i in range(longest):
            rows = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            at, live, nodes = best[rows, i], np.arange(len(rows)), np.zeros(len(rows), np.int64)
            single = np.zeros(len(rows), bool)
            for j in range(i, longest):
                here = lengths[rows[live]] > j
                live, nodes = live[here], nodes[here]
                to, ok = self.trie.step(nodes, grid[rows[live], j])
                live, nodes = live[ok], to[ok]
                if not len(live):
                    break
                v = self.trie.value[nodes]
                end = v >= 0
                who, v = live[end], v[end]
                single[who] |= wide[rows[who], i] == j + 1 - i
                score = at[who] + self.scores[v]
                better = score > best[rows[who], j + 1]
                who, v, r = who[better], v[better], rows[who[better]]
                best[r, j + 1], back[r, j + 1], via[r, j + 1] = score[better], i, v
            r = rows[~single]
            end, score = i + wide[r, i], at[~single] + self.unknown
            better = score > best[r, end]
            best[r[better], end[better]], back[r[better], end[better]], via[r[better], end[better]] = score[better], i, -1
        back_, via_, out = back.tolist(), via.tolist(), []
        for k, text in enumerate(texts):
            n, one = len(text), []
            while n:
                i, v = back_[k][n], via_[k][n]
                one += [int(self.ids[v])] if v >= 0 else [int(self.byte_ids[b]) for b in reversed(text[i:n])]
                n = i
            out.append(one[::-1])
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(texts)
        short = sorted((i for i, t in enumerate(texts) if 0 < len(t) <= TOGETHER), key=lambda i: len(texts[i]))
        for a in range(0, len(short), 20_000):
            group = short[a : a + 20_000]
            for i, ids in zip(group, self._together([texts[i] for i in group]), strict=True):
                found[i] = ids
        for i, t in enumerate(texts):
            if found[i] is None:
                found[i] = self._walk(t)
        return np.array([x for one in found for x in one], np.int32), np.array([len(one) for one in found], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, the leading markers of texts still in them."""
        return self.flat[ragged(self.first[ids], self.width[ids])]


def char_width(text: bytes, i: int) -> int:
    c = text[i]
    return min(len(text) - i, 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0))


_loaded: dict[str, tuple[Pieces, UnitIds]] = {}


def pieces(path: str) -> tuple[Pieces, UnitIds]:
    """The vocabulary of a model file and its dictionary of solved stretches, kept by a worker."""
    if path not in _loaded:
        vocabulary = Pieces.from_model(path)
        _loaded[path] = vocabulary, UnitIds(vocabulary)
    return _loaded[path]


def marked(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a marker before each that isn't empty."""
    full = np.diff(offsets) > 0
    return np.insert(buf, offsets[:-1][full], 0x20), offsets + np.concatenate([[0], np.cumsum(full)])


def id_blocks(batches, path: str):
    """Per block of documents: the batch, its marked bytes and offsets, all ids and their numbers."""
    vocabulary, units = pieces(path)
    for block in text_blocks(batches):
        buf, offsets = marked(*flat(block.column("text")))
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (buf[1:] == 0x20) & (buf[:-1] != 0x20)
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        begin, count = units(buf.tobytes(), starts, ends, range_hash(prefix_hash(SYMBOL[buf]), starts, ends))
        before = np.concatenate([[0], np.cumsum(count)])
        yield block, buf, offsets, units.flat[ragged(begin, count)], np.diff(before[np.searchsorted(bounds, offsets)])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int)."""
    path = model or default_model()

    def run(batches):
        for block, _, _, ids, counts in id_blocks(batches, path):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids), mask=block.column("text").is_null())
            yield pa.record_batch([id_array(ids_of(block)), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text, from doc_id and ids."""
    path = model or default_model()

    def run(batches):
        vocabulary, _ = pieces(path)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(np.array(ids, np.int64)).tobytes()[1:].decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task(run), "doc_id long, text string")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """What ``encode`` gives, as figures: ids, byte pieces among them, CRC of the ids (unsigned,
    little-endian unsigned 32-bit), and whether decoding gave the text back."""
    path = model or default_model()

    def run(batches):
        vocabulary, _ = pieces(path)
        is_byte = np.zeros(len(vocabulary.width), bool)
        is_byte[vocabulary.byte_ids] = True
        for block, buf, offsets, ids, counts in id_blocks(batches, path):
            ends = np.concatenate([[0], np.cumsum(counts)])
            n_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])[ends]
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            width = np.concatenate([[0], np.cumsum(vocabulary.width[ids])])[ends]
            back = vocabulary.decode(ids)
            if len(back) == len(buf):
                wrong = np.concatenate([[0], np.cumsum(back != buf)])[offsets]
                same = (np.diff(width) == np.diff(offsets)) & (np.diff(wrong) == 0)
            else:
                same = np.array([back[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(width[:-1], width[1:], offsets[:-1], offsets[1:], strict=True)], bool)
            yield pa.record_batch([id_array(ids_of(block)), pa.array(counts, pa.int64()), pa.array(np.diff(n_bytes), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(task(run), "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
