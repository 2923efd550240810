"""Quality classifier: random-indexing word vectors and a two-layer network.

1. Every word has a sparse random index vector given by its hash.  Over all
   documents, the index vectors of the neighbours of each word are summed into
   a table of hashed words of fixed size: the word vectors.
2. A document is the mean and the spread of the vectors of its words, beside
   the mean of their index vectors.
3. A two-layer network is trained with numpy on a bounded sample of labelled
   documents; a temperature fitted on a part of the sample that training does
   not see calibrates its probabilities.

Words are runs of letters and digits and runs of other signs, as they are
written, so punctuation and capitals count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, quoted, summed_table
from .textops import _mix, release_memory, row_blocks, string_buffers

#: Cells of the table of hashed words, and width of the vectors.
WORD_CELLS, WIDTH = 1 << 13, 32
#: Entries of an index vector that are not 0.
ENTRIES = 4
#: Labelled documents that the network is fitted on at most, the ones with the smallest digests.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 64, 0.01
THRESHOLD = 0.7
BLOCK = 1 << 20

_KIND = np.zeros(256, np.int8)  # 0 blank, 1 letters and digits, 2 other signs
_KIND[33:128] = 2
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class Model(NamedTuple):
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first word (n + 1)."""
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.concatenate([[True], kind[1:] != kind[:-1]])
    begins = offsets[:-1]
    first[begins[begins < len(kind)]] = True
    starts = np.flatnonzero(first)
    # letters of a word are weighted by their place, up to 16 places
    place = np.arange(len(data)) - starts[np.cumsum(first) - 1]
    v = _VALUE[data] * ((place & 15).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) | np.uint64(1))
    h = _mix(np.add.reduceat(v, starts))
    word = kind[starts] > 0
    starts, h = starts[word], h[word]
    return h, np.searchsorted(starts, offsets, "left")


def _index_vectors() -> np.ndarray:
    """The sparse random vectors of all cells."""
    h = _mix(np.arange(WORD_CELLS * ENTRIES, dtype=np.uint64) + np.uint64(77)).reshape(WORD_CELLS, ENTRIES)
    out = np.zeros((WORD_CELLS, WIDTH), np.float32)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1, -1)
    np.add.at(out, (np.arange(WORD_CELLS)[:, None], (h % np.uint64(WIDTH)).astype(np.int64)), sign)
    return out


_INDEX = _index_vectors()


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(65 - WORD_CELLS.bit_length())).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, from all texts; each has length 1 (or 0, if never seen)."""
    entries = [(_mix(np.arange(WORD_CELLS * ENTRIES, dtype=np.uint64) + np.uint64(77)).reshape(WORD_CELLS, ENTRIES)[:, e]) for e in range(ENTRIES)]
    dims = [(x % np.uint64(WIDTH)).astype(np.int64) for x in entries]
    signs = [np.where(x >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.float64) for x in entries]

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        data, offsets = string_buffers(batch["text"])
        for lo, hi in row_blocks(offsets, BLOCK):
            h, first = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cell = _cells(h)
            left, right = cell[:-1], cell[1:]
            joined = np.ones(max(0, len(cell) - 1), dtype=bool)
            inner = first[1:-1]
            joined[inner[(inner > 0) & (inner < len(cell))] - 1] = False  # not across documents
            left, right = left[joined], right[joined]
            for d, s in zip(dims, signs, strict=True):
                for word, near in ((left, right), (right, left)):
                    total += np.bincount(word * WIDTH + d[near], weights=s[near], minlength=len(total)).astype(np.int64)
        release_memory()

    sums = summed_table(docs.select("text"), WORD_CELLS * WIDTH, fill).reshape(WORD_CELLS, WIDTH).astype(np.float64)
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)


def _pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """A row of features for every document: means, spreads and a few sizes."""
    data, offsets = string_buffers(batch["text"])
    both = np.concatenate([vectors, _INDEX], axis=1)
    out = np.zeros((len(offsets) - 1, 3 * WIDTH + 2), np.float32)
    for lo, hi in row_blocks(offsets, BLOCK):
        h, first = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.diff(first)
        some = n > 0
        if not some.any():
            continue
        at, many = first[:-1][some], n[some][:, None].astype(np.float32)
        v = both[_cells(h)]
        mean = np.add.reduceat(v, at, axis=0) / many
        square = np.add.reduceat(v[:, :WIDTH] ** 2, at, axis=0) / many
        size = np.diff(offsets[lo : hi + 1])[some][:, None]
        spread = np.sqrt(np.maximum(0, square - mean[:, :WIDTH] ** 2))
        out[np.flatnonzero(some) + lo] = np.concatenate([mean, spread, np.log1p(many), size / many / 8], axis=1)
    return out


def _whole(v: np.ndarray, most: float) -> np.ndarray:
    """Multiples of 2 ** -16 up to ``most``, as whole numbers."""
    return np.rint(np.clip(np.asarray(v, np.float64), -most, most) * 65536)


def _forward(m: Model, x: np.ndarray) -> np.ndarray:
    """The network's output of every row.

    Products are taken of whole numbers whose sums stay below 2 ** 53, so they
    are exact in any order and a row's output does not depend on the number of
    rows beside it.
    """
    a = (x.astype(np.float64) - m.center) / m.scale
    hidden = np.tanh(_whole(a, 256.0) @ _whole(m.w1, 16.0) / 2.0**32 + m.b1)
    return _whole(hidden, 1.0) @ _whole(m.w2, 64.0) / 2.0**32 + m.b2


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(x), m.constant)
    return 1 / (1 + np.exp(-np.clip(_forward(m, x).astype(np.float64) / m.temperature, -500, 500)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Train on four fifths of the rows, calibrate on the last fifth."""
    width = x.shape[1] if x.ndim == 2 else 0
    empty = Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        return empty._replace(constant=0.0 if len(y) and y.max() == 0 else 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: max(1, len(y) // 5)] if len(y) >= 10 else order
    used = order[len(held) :] if len(y) >= 10 else order
    center, scale = x[used].mean(0), x[used].std(0) + 1e-3
    a, t = (x - center) / scale, y.astype(np.float32)
    share = max(1e-3, float(t[used].mean()))
    w = [rng.normal(0, width**-0.5, (width, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.array([np.log(share / max(1e-3, 1 - share))], np.float32)]
    m1, m2, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            hidden = np.tanh(a[chosen] @ w[0] + w[1])
            g = (1 / (1 + np.exp(-(hidden @ w[2] + w[3][0]))) - t[chosen]) / len(chosen)
            back = g[:, None] * w[2] * (1 - hidden**2)
            grads = [a[chosen].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * d
                m2[i] = 0.999 * m2[i] + 0.001 * d * d
                w[i] = w[i] - RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, center, scale, w[0], w[1], w[2], float(w[3][0]), 1.0)
    z, goal = _forward(model, x[held]).astype(np.float64), y[held]

    def loss(temperature: float) -> float:
        s = z / temperature
        return float(np.mean(np.logaddexp(0, s) - goal * s))

    return model._replace(temperature=float(min(np.geomspace(0.25, 16, 97), key=loss)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, fitted without the held-out documents.

    Of the labelled ids the ``SAMPLE`` with the smallest digests are used; the
    word vectors come from all documents.  An id with several labels counts
    once for each distinct one; null ids and labels other than 0 and 1 are left
    out.  Labels of one class only give a constant score: that class; no labels
    at all give 1 (nothing speaks against any document).
    """
    vectors = word_vectors(docs)
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("bm_id"), F.col("quality").cast("int").alias("bm_quality")).distinct()
    chosen = chosen.orderBy(F.md5(F.col("bm_id").cast("string")), "bm_id", "bm_quality").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("bm_id")).select("text", "bm_id", "bm_quality")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pooled(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch["bm_id"], batch["bm_quality"], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "quality", "x"])

    # a row per id and label: repeated documents count once
    found = rows.mapInArrow(pool, "id long, quality int, x binary").groupBy("id", "quality").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (r["id"], r["quality"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]).reshape(len(found), 3 * WIDTH + 2)
    return fit(vectors, x, np.array([r["quality"] for r in found], dtype=np.float64))


def _scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns and the score, under a name that none of them has (the last column)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), free_name(keep, "bm_score")
    rows = docs.select("text", *[quoted(c) for c in keep if c != "text"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = probabilities(m, _pooled(batch, m.vectors))
            release_memory()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p, pa.float64())], names=[*keep, name])

    return rows.mapInArrow(score, extended(rows.select(*map(quoted, keep)).schema, **{name: "double"}))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``.

    ``score`` is the calibrated probability of quality 1; nothing but the text
    enters it.  Null and empty texts get the score of a text without words.
    Repeated rows are scored each for itself; a null doc_id is not held out.
    Other columns are ignored; an empty table gives an empty result.
    """
    out = _scores(docs, train_quality(docs, labels), ["doc_id"])
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("bm_score").alias("score"), (F.col("bm_score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the classifier does not reject; edge cases as in ``quality_scores``."""
    scored = _scores(docs, train_quality(docs, labels), list(docs.columns))
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*map(quoted, docs.columns))
