"""Quality classifier by co-training of two views of a document.

The content view sees the text (hashed words and shares of characters, lines and repeats), the metadata
view sees the page's data (source, language, length).  Both start from labelled documents; over some rounds
each passes its confident verdicts on all other documents to the other as pseudo-labels.  Both are
then calibrated on labelled documents held back from training, a small logistic model combines the
calibrated views, and every document is scored in one pass without a shuffle.

Only the labelled documents are a bounded sample, by smallest hash of doc_id: ``LABELLED`` at most, a fifth
of them held back for calibration and a tenth, which nothing is fitted on, for the threshold.  Every other document takes part in each round without a label: both views of all
documents are computed once and kept, each task adds up the gradients and Hessians of its confident
documents, and Newton steps are taken from those sums.  Whatever their number, the pseudo-labels of a class
weigh as much as its labelled documents at most, so large inputs behave as small ones.  A document is rejected below the threshold, which is 0.5
or, if lower, the score that at most ``LOST_GOOD`` of that tenth's good documents fall below.

Nulls and edge cases: a null or empty text has the features of an empty one; null metadata is a value of
its own; a doc_id labelled several times counts once with its lowest quality; with no labels, or of one
class only, every document scores 1 and stays; a null doc_id is scored but never a training row; empty
tables give no rows; other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .components import without
from .kernels import LOWER, NULL_ID, PACKED, deal, flat, id_array, ids_of, mix, packed, shared, task, text_blocks, word_hashes, words_of

LABELLED = 12_000
ROUNDS, CONFIDENT = 3, 0.97
PASSES = 4  # over all documents in a round, at most
HASHED = 192
META_HASHED = {"source": 192, "lang": 24}  # slots of their own
LOST_GOOD = 0.005
PENALTY = 1.0
_U = np.uint64

CLASSES = [  # shares of bytes, seen as one kind
    np.isin(np.arange(256), list(b"#*$%&|<>")), np.isin(np.arange(256), list(b"0123456789")), np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    np.isin(np.arange(256), list(b".,;:!?")), np.isin(np.arange(256), list(b"(){}[]=_/\\@+~^")), np.arange(256) == 10, np.arange(256) >= 0x80,
]


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def content_features(batch) -> np.ndarray:
    buf, offsets = flat(batch.column("text"))
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, first = words_of(buf, offsets)
    count = np.diff(first)
    words = np.maximum(count, 1)
    shares = [_per_doc(c[buf], offsets) / size for c in CLASSES]
    length = ends - starts
    last = buf[ends - 1] if len(ends) else buf[:0]
    doc = np.repeat(np.arange(len(count)), count)
    hashes = word_hashes(LOWER[buf], starts, ends)
    mixed = mix(hashes ^ doc.astype(_U))
    distinct = np.zeros(len(count))
    if len(doc):
        _, at = np.unique(mixed, return_index=True)
        distinct = np.bincount(doc[at], minlength=len(count))
    more = [
        np.log1p(count), _per_doc(length, first) / words, _per_doc(length > 15, first) / words, _per_doc(length <= 2, first) / words,
        _per_doc(CLASSES[0][last], first) / words, _per_doc((length == 1) & CLASSES[0][last], first) / words, distinct / words, count == 0,
    ]
    table = np.bincount(doc * HASHED + (hashes % _U(HASHED)).astype(np.int64), minlength=len(count) * HASHED).reshape(len(count), HASHED).astype(np.float64)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    return np.column_stack([*shares, *more, table]).astype(np.float32)


def _slots(column, k: int, slots: int) -> np.ndarray:
    """A slot for each value by its whole text; null is a value of its own."""
    buf, offsets = flat(column)
    key = word_hashes(buf, offsets[:-1], offsets[1:]) + _U(2 * k) + np.asarray(column.is_null()).astype(_U)
    return (mix(key) % _U(slots)).astype(np.int64)


def meta_features(batch) -> np.ndarray:
    n = batch.num_rows
    tables = []
    for k, (name, slots) in enumerate(META_HASHED.items()):
        table = np.zeros((n, slots), np.float32)
        table[np.arange(n), _slots(batch.column(name), k, slots)] = 1
        tables.append(table)
    chars = np.array([max(c or 0, 0) for c in batch.column("n_chars").to_pylist()], np.float64)
    bucket = np.minimum(np.log2(chars + 1), 20).astype(int)
    onehot = np.zeros((n, 21), np.float32)
    onehot[np.arange(n), bucket] = 1
    return np.column_stack([*tables, onehot, np.log1p(chars) / 10]).astype(np.float32)


def _blocks(batches):
    for batch in text_blocks(batches):
        for at in range(0, batch.num_rows, 4096):
            yield batch.slice(at, 4096)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    """L2-penalised logistic model on standardised features, classes weighted to be even."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, even: bool = True, steps: int = 12) -> Logistic:
        x = x.astype(np.float64)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        share = np.where(y == 1, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9))
        row = 0.5 / share if even else np.ones(len(y))
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], PENALTY)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (row * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (row * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    cal_text: Logistic
    cal_meta: Logistic
    both: Logistic
    threshold: float
    given: tuple = ()  # pseudo-labels of the last round, by view that got them and class

    def scores(self, text: np.ndarray, meta: np.ndarray):
        a, b = self.cal_text.logit(self.text.logit(text)[:, None]), self.cal_meta.logit(self.meta.logit(meta)[:, None])
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both.logit(np.column_stack([a, b])))


def _views(docs: DataFrame) -> DataFrame:
    """Both views of every row, a block in each row, kept for the passes of the fit and the scoring."""

    def run(batches):
        for batch in _blocks(batches):
            rows = [zlib.compress(x.tobytes(), 1) for x in (ids_of(batch), content_features(batch), meta_features(batch))]
            yield pa.record_batch([pa.array([x], pa.binary()) for x in rows], ["doc_id", "a", "b"])

    return shared(_columns(docs).mapInArrow(task(run), "doc_id binary, a binary, b binary"))


def _read(batches):
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("doc_id", "a", "b")), strict=True):
            ids, *views = (zlib.decompress(x.as_py()) for x in row)
            ids = np.frombuffer(ids, np.int64)
            yield ids, *(np.frombuffer(x, np.float32).reshape(len(ids), -1) for x in views)


def _gather(views: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids and both views of the ``chosen`` documents, ordered by doc_id."""

    def run(batches):
        for ids, *both in _read(batches):
            at = np.flatnonzero(np.isin(ids, chosen))
            yield pa.record_batch([pa.array(ids[at]), *(pa.array([row.tobytes() for row in x[at]], pa.binary()) for x in both)], ["doc_id", "a", "b"])

    found = views.mapInArrow(task(run), "doc_id long, a binary, b binary").toArrow().sort_by([("doc_id", "ascending"), ("a", "ascending"), ("b", "ascending")])
    tables = [np.frombuffer(b"".join(found.column(c).to_pylist()), np.float32).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 1), np.float32) for c in "ab"]
    return np.asarray(found.column("doc_id").combine_chunks()), *tables


def _sums(model: Logistic, x: np.ndarray, verdict: int) -> np.ndarray:
    """Number, loss, gradient and Hessian of rows that are all of one class."""
    d = len(model.weight) + 1
    if not len(x):
        return np.zeros(2 + d + d * d)
    z = np.column_stack([(x.astype(np.float64) - model.mean) / model.scale, np.ones(len(x))])
    logit = z @ np.append(model.weight, model.bias)
    p = _sigmoid(logit)
    return np.concatenate([[len(x), np.logaddexp(0, -logit if verdict else logit).sum()], z.T @ (p - verdict), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel()])


def _pseudo_sums(views: DataFrame, known: np.ndarray, teachers: list[Logistic], students: list[Logistic]) -> list[list[np.ndarray]]:
    """By student and class: ``_sums`` over all documents not ``known`` of which the other view is sure."""
    n = max(1, math.isqrt(views.rdd.getNumPartitions()))
    sizes = [2 + d + d * d for d in (len(m.weight) + 1 for m in students) for _ in (0, 1)]

    def run(batches):
        total = np.zeros(sum(sizes))
        for ids, *both in _read(batches):
            free = (ids != NULL_ID) & ~np.isin(ids, known)
            sure = [_sigmoid(m.logit(x)) for m, x in zip(teachers, both, strict=True)]
            total += np.concatenate([_sums(students[me], both[me][free & ((sure[1 - me] >= CONFIDENT) if verdict else (sure[1 - me] <= 1 - CONFIDENT))], verdict) for me in (0, 1) for verdict in (0, 1)])
        yield packed([TaskContext.get().partitionId() % n], [total.tobytes()])

    def add(batches):
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if blobs:
            yield packed([0], [np.sum([np.frombuffer(x) for x in blobs], axis=0).tobytes()])

    found = deal(views.mapInArrow(task(run), PACKED), n).mapInArrow(task(add), PACKED).collect()  # as many rows as the root of the tasks
    parts = np.split(np.sum([np.frombuffer(r.blob) for r in found], axis=0) if found else np.zeros(sum(sizes)), np.cumsum(sizes)[:-1])
    return [parts[:2], parts[2:]]


def _newton(model: Logistic, x: np.ndarray, y: np.ndarray, pseudo: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Loss at ``model`` and the step from there, classes weighted to be even as in ``Logistic.fit``."""
    w = np.append(model.weight, model.bias)
    ridge = np.full(len(w), PENALTY)
    ridge[-1] = 1e-6
    given = [_sums(model, x[y == c], c) for c in (0, 1)]
    sums = [g + q * min(1.0, g[0] / max(q[0], 1)) for g, q in zip(given, pseudo, strict=True)]
    total = sum(q * (0.5 * (sums[0][0] + sums[1][0]) / max(q[0], 1)) for q in sums)
    loss, slope, bend = total[1] + 0.5 * (ridge * w * w).sum(), total[2 : 2 + len(w)] + ridge * w, total[2 + len(w) :].reshape(len(w), -1)
    return loss, -np.linalg.solve(bend + np.diag(ridge), slope)


def _taught(views: DataFrame, known: np.ndarray, teachers: list[Logistic], tables, marks) -> tuple[list[Logistic], tuple]:
    """Both models after a round, from where they stand, and the numbers of pseudo-labels by student and class."""
    moved, best, lows, steps = list(teachers), list(teachers), [np.inf, np.inf], [np.zeros(len(m.weight) + 1) for m in teachers]
    for _ in range(PASSES):
        sums = _pseudo_sums(views, known, teachers, moved)
        for me in (0, 1):
            loss, step = _newton(moved[me], tables[me], marks, sums[me])
            if loss <= lows[me] + 1e-9 * abs(loss):
                best[me], lows[me], steps[me] = moved[me], loss, step
            else:
                steps[me] = steps[me] / 4
            moved[me] = replace(best[me], weight=best[me].weight + steps[me][:-1], bias=float(best[me].bias + steps[me][-1]))
        if max(np.abs(s).max() for s in steps) < 1e-3:
            break
    return best, tuple(tuple(int(q[0]) for q in x) for x in sums)


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long"), "text", *((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[Model, DataFrame] | None:
    """The model and the views it was fitted on; None if the labels are of fewer than two classes."""
    docs = _columns(docs)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    truth = {r.doc_id: int(r.quality > 0) for r in known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(labelled).collect()}
    if len(set(truth.values())) < 2:
        return None
    views = _views(docs)
    chosen = np.array(sorted(truth), np.int64)
    ids, text, meta = _gather(views, chosen)
    mark = np.array([truth[int(i)] for i in ids])
    part = mix(ids.view(np.uint64)) % _U(10)
    held, last = part < 2, part == 2
    train = part > 2
    if any(len(set(mark[rows])) < 2 for rows in (held, train)) or not (last & (mark == 1)).any():
        held = train = last = np.ones(len(ids), bool)  # too few to hold any back
    models = [Logistic.fit(v[train], mark[train]) for v in (text, meta)]
    given: tuple = ((0, 0), (0, 0))
    for _ in range(rounds):
        models, given = _taught(views, chosen, models, (text[train], meta[train]), mark[train])
    logits = [m.logit(v[held]) for m, v in zip(models, (text, meta), strict=True)]
    calibrated = [Logistic.fit(z[:, None], mark[held], even=False) for z in logits]
    pair = np.column_stack([c.logit(z[:, None]) for c, z in zip(calibrated, logits, strict=True)])
    both = Logistic.fit(pair, mark[held], even=False)
    model = Model(*models, *calibrated, both, 0.5, given)
    good = model.scores(text[last], meta[last])[2][mark[last] == 1]
    return replace(model, threshold=float(min(0.5, np.quantile(good, LOST_GOOD)))), views


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, both views' probabilities of good quality, the combined score and whether it is kept."""
    fitted = fit(docs, labels, **bounds)
    schema = "doc_id long, p_text double, p_meta double, score double, kept boolean"
    if fitted is None:
        one = F.lit(1.0)
        return _columns(docs).select("doc_id", one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(True).alias("kept"))
    model, views = fitted

    def run(batches):
        for ids, text, meta in _read(batches):
            p = model.scores(text, meta)
            yield pa.record_batch([id_array(ids), *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= model.threshold)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return views.mapInArrow(task(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return without(docs, shared(score(docs, labels).where("NOT kept").select("doc_id")), "doc_id")
