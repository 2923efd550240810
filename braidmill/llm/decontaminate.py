"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard (a few MB of documents) gets a suffix array over its words.  Only
suffixes that could begin like a test suffix are kept in it: their words are
known to the benchmark as far as the shortest window that starts with their
first two words.  Every test suffix is located in every shard by binary search,
which gives all its verbatim occurrences; those that follow each other in
document and item are joined into the longest matches, with their places.  Hit
words, items found and the documents to remove are read off the longest
matches.  Shards are independent, so nothing is shuffled.

A benchmark above ``BLOCK_BYTES`` is taken in blocks of that size.  There is
one pass over the documents; for every batch of them a task goes through the
blocks one after the other and holds one of them, as does the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textops import ALNUM_WORDS, release_memory, row_blocks, string_buffers, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
#: Occurrences (places times item places) joined into matches at once.
EXPANDED = 2_000_000


class Suffixes(NamedTuple):
    """Test suffixes of one benchmark block, cut at the window's length."""

    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place + 1
    keys: np.ndarray  # distinct windows, encoded so that bytes sort like words
    upper: np.ndarray  # the first key after all suffixes that start with the window
    lengths: np.ndarray  # words of the window
    first: np.ndarray  # where each window's places begin in items and offsets
    items: np.ndarray
    offsets: np.ndarray
    least: np.ndarray  # by word id: the shortest window that starts so
    pairs: np.ndarray  # sorted starts (two ids) of windows of two words or more
    names: list  # item ids as strings


def _encode(ids: np.ndarray) -> np.ndarray:
    width = ids.shape[1] * 4
    return np.frombuffer(np.ascontiguousarray(ids, dtype=">i4").tobytes(), dtype=f"S{width}")


def test_suffixes(names: list[str], texts: list[str | None], window: int = WINDOW) -> Suffixes:
    data, rows = string_buffers(pa.array(texts, pa.large_string()))
    _, _, h, first = words(data, rows, ALNUM_WORDS)
    vocabulary, ids = np.unique(h, return_inverse=True)
    ids = np.concatenate([ids + 1, np.zeros(window, np.int64)])
    starts, items, lengths = [], [], []
    for k in range(len(texts)):
        n = int(first[k + 1] - first[k])
        if n:
            m = max(1, n - window + 1)
            starts.append(np.arange(first[k], first[k] + m))
            items.append(np.full(m, k))
            lengths.append(np.full(m, min(n, window)))
    starts, items, lengths = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, items, lengths))
    grid = ids[starts[:, None] + np.arange(window)]
    grid[np.arange(window) >= lengths[:, None]] = 0
    keys, at, group = np.unique(_encode(grid), return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    ends = grid[at].copy()
    if len(at):
        ends[np.arange(len(at)), lengths[at] - 1] += 1
    least = np.full(len(vocabulary) + 1, 1 << 30)
    np.minimum.at(least, grid[:, 0], lengths)
    pairs = np.unique(grid[lengths > 1][:, :2] @ np.array([1 << 32, 1]))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(keys)))])
    return Suffixes(vocabulary, keys, _encode(ends), lengths[at], bounds, items[order], (starts - first[items])[order], least, pairs, names)


def _occurrences(ids: np.ndarray, t: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of all occurrences; id 0 is an unknown word or the end of a text."""
    n = len(ids)
    stop = np.where(ids == 0, np.arange(n), n)
    reach = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
    here = np.flatnonzero(reach >= t.least[ids])
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    if len(t.pairs):
        two = padded[here] << 32 | padded[here + 1]
        at = np.minimum(np.searchsorted(t.pairs, two), len(t.pairs) - 1)
        here = here[(t.pairs[at] == two) | (t.least[ids[here]] == 1)]
    if not len(here) or not len(t.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = _encode(padded[here[:, None] + np.arange(window)])
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    keys, here = keys[order], here[order]
    lo, hi = np.searchsorted(keys, t.keys, "left"), np.searchsorted(keys, t.upper, "left")
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return here[np.repeat(lo[found], count) + inner], np.repeat(found, count)


class _Shard(NamedTuple):
    lo: int
    hi: int
    text_of: np.ndarray  # of each place in the padded words, the row
    begin: np.ndarray  # of each row, its first place
    n_words: np.ndarray
    places: np.ndarray
    windows: np.ndarray


def _shards(batch: pa.RecordBatch, t: Suffixes, window: int) -> Iterator[_Shard]:
    data, offsets = string_buffers(batch["text"])
    for lo, hi in row_blocks(offsets, SHARD_BYTES):
        _, _, h, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM_WORDS)
        known = np.zeros(len(h), dtype=np.int64)
        if len(t.vocabulary):
            at = np.minimum(np.searchsorted(t.vocabulary, h), len(t.vocabulary) - 1)
            known = np.where(t.vocabulary[at] == h, at + 1, 0)
        n_words = np.diff(first)
        begin = first[:-1] + np.arange(hi - lo)  # one place after each text stays 0
        text_of = np.repeat(np.arange(hi - lo), n_words + 1)
        ids = np.zeros(len(text_of), dtype=np.int64)
        ids[np.arange(len(h)) + text_of_words(n_words)] = known
        places, found = _occurrences(ids, t, window)
        yield _Shard(lo, hi, text_of, begin, n_words, places, found)


def text_of_words(n_words: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(n_words)), n_words)


class _Matches(NamedTuple):
    """Longest matches: document row, item, first word in both, number of words."""

    row: np.ndarray
    item: np.ndarray
    doc_word: np.ndarray
    item_word: np.ndarray
    n_words: np.ndarray


def _matches(s: _Shard, t: Suffixes) -> Iterator[_Matches]:
    """The shard's longest matches.  Where occurrences are many, diagonals are dealt over several rounds."""
    count = t.first[s.windows + 1] - t.first[s.windows]
    before = np.concatenate([[0], np.cumsum(count)])
    rounds = -(-int(before[-1]) // EXPANDED)
    for r in range(rounds):
        parts = []
        for k in range(rounds):
            lo, hi = np.searchsorted(before, [k * EXPANDED, (k + 1) * EXPANDED], "left")
            lo, hi = min(lo, len(count)), min(hi, len(count))
            n = count[lo:hi]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(t.first[s.windows[lo:hi]], n) + inner
            p, q = np.repeat(s.places[lo:hi], n), t.offsets[place]
            own = (p - q) % rounds == r
            parts.append((p[own], q[own], t.items[place][own], np.repeat(t.lengths[s.windows[lo:hi]], n)[own]))
        p, q, item, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = s.text_of[p]
        order = np.lexsort((p, p - q, item, row))
        p, q, item, length, row = p[order], q[order], item[order], length[order], row[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
        a = np.flatnonzero(new)
        run = np.diff(np.append(a, len(p)))
        yield _Matches(row[a], item[a], p[a] - s.begin[row[a]], q[a], run + length[a] - 1)


def _scan(t: Suffixes, window: int, batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """Of each row: number of words, hit words as packed bits, ids of the items found."""
    sizes, hits, names = [], [], []
    for s in _shards(batch, t, window):
        edges = np.zeros(len(s.text_of) + 1, dtype=np.int64)
        own: list[set[str]] = [set() for _ in range(s.hi - s.lo)]
        for m in _matches(s, t):
            at = s.begin[m.row] + m.doc_word
            np.add.at(edges, at, 1)
            np.add.at(edges, at + m.n_words, -1)
            for r, item in np.unique(np.stack([m.row, m.item], 1), axis=0).tolist():
                own[r].add(t.names[item])
        hit = np.cumsum(edges)[:-1] > 0
        for r, (a, n) in enumerate(zip(s.begin.tolist(), s.n_words.tolist(), strict=True)):
            sizes.append(n)
            hits.append(np.packbits(hit[a : a + n]) if own[r] else np.zeros(0, np.uint8))
            names.append(own[r])
    return sizes, hits, names


def _benchmark_blocks(benchmark: DataFrame, window: int) -> Iterator[Suffixes]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        found = part.collect()  # at most about BLOCK_BYTES
        yield test_suffixes([r["item_id"] for r in found], [r["text"] for r in found], window)


def _each(blocks: list[Broadcast]) -> Iterator[Suffixes]:
    """The blocks in turn; a worker that has several forgets each after use and reads it again from its disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            vars(block).pop("_value", None)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, finish, schema: str | StructType) -> DataFrame:
    """``docs`` against all blocks; finish(batch, sizes, hits, names) makes the rows."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(t) for t in _benchmark_blocks(benchmark, window)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sizes, hits, names = [0] * n, [np.zeros(0, np.uint8)] * n, [set()] * n
            for t in _each(blocks):
                sizes, more, found = _scan(t, window, batch)
                hits = [(a | b) if len(a) == len(b) else max(a, b, key=len) for a, b in zip(hits, more, strict=True)]
                names = [a | b for a, b in zip(names, found, strict=True)]
            yield finish(batch, sizes, hits, [sorted(x) for x in names])
            release_memory()

    return docs.mapInArrow(step, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  ``n_hit`` counts the document words inside any longest match;
    ``n_items`` the distinct item ids with matches; ``items_sha256`` hashes
    those ids (sorted as strings, joined by commas; the empty string if there
    are none).  Null and empty texts have no words and are not contaminated; a
    null item_id counts as the empty string.  Repeated rows are judged each for
    itself; other columns are ignored.  Texts of any length are taken whole.
    With an empty benchmark nothing is contaminated; an empty table gives an
    empty result.
    """

    def finish(batch, sizes, hits, names):
        n_hit = [int(np.unpackbits(h)[:n].sum()) for h, n in zip(hits, sizes, strict=True)]
        columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = _scanned(rows, benchmark, window, finish, "doc_id long, n_words long, n_hit long, items array<string>")
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark; edge cases as in ``contamination``."""

    def finish(batch, sizes, hits, names):
        return batch.filter(pa.array([not x for x in names], pa.bool_()))

    return _scanned(docs, benchmark, window, finish, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id string, doc_word, item_word, n_words): all longest verbatim matches.

    These are the matches that ``contamination`` and ``remove_contaminated``
    judge by.  A match can be extended by no word at either end.  Words count
    from 0.  Edge cases as in ``contamination``.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(t) for t in _benchmark_blocks(benchmark, window)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _each(blocks):
                for s in _shards(batch, t, window):
                    ids = batch["doc_id"].slice(s.lo, s.hi - s.lo)
                    for m in _matches(s, t):
                        columns = [ids.take(pa.array(m.row)), pa.array([t.names[i] for i in m.item], pa.string()), *map(pa.array, m[2:])]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    schema = "doc_id long, item_id string, doc_word long, item_word long, n_words long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, schema)
