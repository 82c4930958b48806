import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from fixtures import corpus, frame
from tokenizers import Tokenizer

from termlink.llm import packing, pieces
from termlink.llm.queries import QUERIES

ODD = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "22", "\xa0", "　", "'s", "!", " ", "漢", "😀", "\x1c", "\x85", "ß ", "▁", "the", "ing", "<|endoftext|>"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def check_pieces(rows, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids, at = [*model.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark):
    texts = [*corpus(5, 40), *odd_texts(300, 1)]
    for parts, flush in ((1, 200_000), (3, 50)):
        rows = packing.pack(frame(spark, texts).repartition(parts), flush=flush).collect()
        sequences, tokens = check_pieces(rows, texts)
        if parts == 1:
            assert sequences <= tokens / packing.WINDOW * 1.05 + 1
    assert packing.pack(frame(spark, [])).count() == 0
    assert [r.doc_id for r in packing.pack(frame(spark, ["x"], ids=[None])).collect()] == [None]


def test_segment_tree_is_best_fit():
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    room: list[int] = []
    expected = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        best = min(fits, default=None)
        expected.append(best)
        if best is None:
            room.append(100 - sizes[i])
        else:
            room[room.index(best)] -= sizes[i]
    tree, found = packing.OpenWindows(100), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        before = list(tree.used)
        window, offset = tree.fit(sizes[i])
        found.append(None if window >= len(before) else 100 - before[window])
        assert offset == (before[window] if window < len(before) else 0)
    assert found == expected


def test_double_array_is_a_dictionary():
    rng = random.Random(6)
    keys = list({bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 6))) for _ in range(500)})
    trie = pieces.DoubleArray(keys)
    for word in {bytes(rng.choice(b"abc d") for _ in range(rng.randint(1, 7))) for _ in range(2000)} | set(keys):
        node, ok = np.zeros(1, np.int64), True
        for c in word:
            node, good = trie.step(node, np.array([c]))
            ok = ok and bool(good[0])
            if not ok:
                break
        value = int(trie.value[node[0]]) if ok else -1
        assert (value >= 0) == (word in keys) and (value < 0 or keys[value] == word)


def small():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "é", "▁▁", "aab"]
    return pieces.Pieces(names, list(range(300, 300 + len(names))), [-3.1, -2.3, -2.0, -2.9, -3.3, -4.15, -3.05, -5.2, -6.0, -3.7, -4.4], list(range(256)))


def best_score(model, text):
    """The highest score over all segmentations."""
    scores = dict(zip(model.keys, model.scores, strict=True))
    best = {0: 0.0}
    for i in range(len(text)):
        if i in best:
            wide = pieces.char_width(text, i)
            if text[i : i + wide] not in scores:
                best[i + wide] = max(best.get(i + wide, -1e9), best[i] + model.unknown)
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in scores:
                    best[j] = max(best.get(j, -1e9), best[i] + scores[text[i:j]])
    return best[len(text)]


def test_viterbi_is_optimal():
    model, rng = small(), random.Random(7)
    texts = ["".join(rng.choice(["a", "b", " ", "é", "x", "漢"]) for _ in range(rng.randint(1, 12))).encode() for _ in range(800)] + [b"ab" * 100]
    ids, counts = model(texts)
    ends = np.cumsum(counts)
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        mine = ids[a:b].tolist()
        assert model.decode(np.array(mine)).tobytes() == text and mine == model._walk(text)
        total, raw = 0.0, bytearray()
        for i in mine:
            total += score.get(i, 0.0)
            raw += bytes([i]) if i < 256 else b""
        total += model.unknown * len(raw.decode())
        assert abs(total - best_score(model, text)) < 1e-9


def test_encode_and_decode(spark):
    texts = [*corpus(6, 30), *odd_texts(200, 2), "  two  spaces ", "▁marker ▁"]
    docs = frame(spark, texts)
    coded = pieces.encode(docs)
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == dict(enumerate(texts))
    by_id = {r.doc_id: r.ids for r in coded.collect()}
    for r in pieces.digest(docs).collect():
        ids = by_id[r.doc_id] or []
        assert r.round_trip and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert by_id[0] is None and by_id[1] == [] and pieces.encode(frame(spark, [])).count() == 0


def test_equals_the_library(tmp_path):
    """The same pieces and scores as a unigram model of the sentencepiece library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    ours = pieces.Pieces.from_model(pieces.default_model())
    proto = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    scores = dict(zip(ours.ids.tolist(), ours.scores.tolist(), strict=True))
    for i, p in enumerate(proto.pieces):
        p.score = scores.get(i, 0.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice(["th", "e", "ing", "é", "漢", "q", "Z", "0", "-"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    for text in texts:
        mine = ours._walk((" " + text).encode())
        theirs = library.encode(text)
        total = lambda ids: round(sum(scores.get(i, 0.0) for i in ids), 3)
        assert mine == theirs or total(mine) == total(theirs)  # single precision may break ties otherwise


def test_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert [r.doc_id for r in docs] == list(range(len(docs)))
    check_pieces(QUERIES["op9_pack_best_fit"](spark, sf_dir).collect(), [r.text for r in docs])
    rows = QUERIES["op6_unigram_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)
