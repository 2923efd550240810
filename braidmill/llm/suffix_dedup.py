"""Repeated passages by a sparse suffix array.

Suffixes are kept at content-selected places only.  A stretch of ``LENGTH``
words has ``LENGTH - SEED + 1`` places where ``SEED`` words begin; its minimiser
is the place whose words have the smallest hash (the leftmost of equal ones).
Equal stretches have it at the same offset, so they meet at one kept suffix,
and about one place in twenty is kept.

1. *Sort*: the kept suffixes of all distinct texts are put into one order, by
   their leading ``SEED`` words (hashed), then text and place, by range
   partitions.  A suffix that a third of all texts hold spreads over as many
   partitions as it takes.
2. *Compare neighbours*: suffixes that begin alike are neighbours and form a
   run.  Nothing else can share a stretch.
3. *Extend left and right*: a kept suffix carries the hashes (48 bits beside
   the seed's 64) of the stretches it is the minimiser of, from the one that
   reaches furthest left to the one furthest right.  Offset by offset these are
   compared in the whole run, not with the next suffix alone, which would lose
   what is shared with a third one only.  Stretches that agree are joined into
   maximal passages.

A run that a partition's border may cut, or that is longer than ``RUN_ROWS``,
is taken apart: each part sums up its distinct stretches, these sums meet in
buckets of bounded size, and each part is told which of its stretches occur
again.  The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .textops import SPACE_WORDS, _mix, gram_hashes, release_memory, row_blocks, string_buffers, words

LENGTH, SEED = 50, 10
#: Suffixes of one range partition, and the most of one run that a task holds.
PARTITION_ROWS, RUN_ROWS = 200_000, 20_000
#: Suffixes compared at once, and bytes of text cut into suffixes at once.
CHUNK_ROWS, BLOCK_BYTES = 40_000, 2 << 20
#: Stretches of cut runs that meet in one task.
BUCKET_STRETCHES = 1_000_000
_SEEN = 200_000
_HASH_BYTES, _OFFSET_BITS = 6, 16
_ROWS = "seed long, key long, place int, off int, words int, own binary"
_TOLD = "key long, start int, stop int, head boolean, copy_key long, copy_word int"
_TOLD_NAMES = [f.split()[0] for f in _TOLD.split(", ")]
#: Packed rows: told ones, or those of a chunk that is left (with its number of stretches).
_PACKED = "chunk long, size long, blob binary"
_KINDS = [np.int64, np.int32, np.int32, bool, np.int64, np.int32]


def leftmost_minima(a: np.ndarray, w: int) -> np.ndarray:
    """Of each w neighbours the place of the smallest, by doubling; the leftmost of equal ones."""
    n = len(a) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, step = np.arange(len(a)), 1
    while step * 2 <= w:
        left, right = at[:-step], at[step:]
        at = np.where(a[right] < a[left], right, left)
        step *= 2
    left, right = at[:n], at[w - step :][:n]
    return np.where(a[right] < a[left], right, left)


def _stretch_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring words, for a long n, by halving."""
    out, have = h, 1
    for b in bin(n)[3:]:
        m = len(out) - have
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = out[:m] * np.uint64(0xD6E8FEB86659FD93) + (out[have:] ^ out[have:] >> np.uint64(32))
        have *= 2
        if b == "1":
            m = min(len(out), len(h) - have)
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = out[:m] * np.uint64(0xCA5A826395121157) + (h[have : have + m] ^ h[have : have + m] >> np.uint64(29))
            have += 1
    return _mix(out)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of so many hashes each, cut from one array."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * _HASH_BYTES
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def kept_suffixes(h: np.ndarray, first: np.ndarray, keys: np.ndarray, length: int, seed: int) -> pa.RecordBatch | None:
    """The kept suffixes of a few texts; ``first`` has each text's first word, ``h`` the word hashes.

    ``place`` is the suffix's word in its text, ``off`` how many words before
    it the first of its stretches begins, ``words`` the text's number of words
    in the row of its first stretch (else -1).
    """
    n = len(h) - length + 1
    if n <= 0:
        return None
    text_of = np.repeat(np.arange(len(keys)), np.diff(first))
    start = np.flatnonzero(text_of[:n] == text_of[length - 1 :])
    if not len(start):
        return None
    grams = gram_hashes(h, seed)
    at = leftmost_minima(grams, length - seed + 1)[start]
    a = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.append(a, len(start)))
    own = np.ascontiguousarray(_stretch_hashes(h, length)[start].view(np.uint8).reshape(-1, 8)[:, 8 - _HASH_BYTES :])
    text, place = text_of[start[a]], at[a]
    sizes = np.where(start[a] == first[text], np.diff(first)[text], -1)
    columns = [_mix(grams[place]).view(np.int64), keys[text], (place - first[text]).astype(np.int32), (place - start[a]).astype(np.int32), sizes.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(own, count)], names=["seed", "key", "place", "off", "words", "own"])


def _suffixes(texts: DataFrame, length: int, seed: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for key in batch["key"].to_pylist():
                fresh.append(key not in seen)
                if len(seen) < _SEEN:
                    seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            keys = batch["key"].to_numpy()
            data, offsets = string_buffers(batch["text"])
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                _, _, h, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACE_WORDS)
                if (rows := kept_suffixes(h, first, keys[lo:hi], length, seed)) is not None:
                    yield rows
            release_memory()

    return texts.mapInArrow(emit, _ROWS)


def _stretches(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows' stretches: the row, the first word, and the hash with the offset."""
    _, ends, data = t["own"].buffers()
    ends = np.frombuffer(ends, np.int32)[t["own"].offset :][: len(t) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, _HASH_BYTES)
    count = np.diff(ends) // _HASH_BYTES
    row = np.repeat(np.arange(len(t)), count)
    off = t["off"].to_numpy().astype(np.int64)[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, 2:] = raw
    return row, t["place"].to_numpy()[row] - off, value.view(np.uint64).ravel() | off.astype(np.uint64)


def _same_run(seed: np.ndarray) -> np.ndarray:
    """Whether each row begins like the one before."""
    return np.concatenate([[False], seed[1:] == seed[:-1]])


def compare_runs(t: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Passages and heads of whole runs, sorted by seed, key and place.

    A passage row spans neighbouring stretches of one suffix that occur again;
    a head row (one a text) tells the words of the text and where its first
    stretch occurs first.
    """
    seed, key, place, sizes = (t[c].to_numpy() for c in ("seed", "key", "place", "words"))
    like = _same_run(seed)
    twice = like & np.concatenate([[False], (key[1:] == key[:-1]) & (place[1:] == place[:-1])])  # a text that two tasks told
    near = (like | np.append(like[1:], False)) & ~twice
    lone = ~near & ~twice & (sizes >= 0)
    zeros = np.zeros(int(lone.sum()), np.int32)
    out = [[c.astype(k) for c, k in zip((key[lone], zeros, sizes[lone], zeros > -1, key[lone], zeros), _KINDS, strict=True)]]
    t = t.filter(pa.array(near))
    if len(t):
        key, sizes, run = t["key"].to_numpy(), t["words"].to_numpy(), np.cumsum(~_same_run(t["seed"].to_numpy()))
        row, start, value = _stretches(t)
        value = _mix(value ^ _mix(run.astype(np.uint64))[row])
        order = np.argsort(value, kind="stable")  # equal ones stay in order of text and place
        fresh = np.concatenate([[True], value[order][1:] != value[order][:-1]])
        group = np.cumsum(fresh) - 1
        again, origin = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
        again[order] = np.bincount(group)[group] > 1
        origin[order] = order[fresh][group]
        out.append(_told(key, sizes, row, start, again, key[row[origin]], start[origin], length))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=_TOLD_NAMES)


def _told(key: np.ndarray, sizes: np.ndarray, row: np.ndarray, start: np.ndarray, again: np.ndarray, copy_key: np.ndarray, copy_word: np.ndarray, length: int) -> list[np.ndarray]:
    """Columns of the passage and head rows; ``row`` to ``copy_word`` are of stretches, in order of row and place."""
    joined = again[1:] & again[:-1] & (row[1:] == row[:-1])
    a = np.flatnonzero(again & ~np.concatenate([[False], joined]))
    b = np.flatnonzero(again & ~np.concatenate([joined, [False]]))
    head = np.flatnonzero((sizes[row] >= 0) & (start == 0))
    both = np.concatenate([a, head])
    columns = [key[row[both]], start[both], np.concatenate([start[b] + length, sizes[row[head]]]), np.arange(len(both)) >= len(a), copy_key[both], copy_word[both]]
    return [c.astype(k) for c, k in zip(columns, _KINDS, strict=True)]


def _pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _packed(rows: pa.RecordBatch, chunk: int | None = None) -> pa.RecordBatch:
    """Told rows, or rows whose runs the partition does not see whole, as one row."""
    size = None if chunk is None else int(pc.sum(pc.binary_length(rows["own"])).as_py()) // _HASH_BYTES
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(rows)], pa.binary())], names=["chunk", "size", "blob"])


def _compared(suffixes: DataFrame, parts: int, length: int, run_rows: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, held, n_held = None, [], 0  # rows of the last run so far, which may go on
        left, n_left, chunk = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            if not len(batch):
                continue
            seeds = batch["seed"].to_numpy()
            if passed is None:  # the first run may have begun in the partition before
                passed = seeds[0]
            skip = int(np.searchsorted(seeds, passed, "right")) if seeds[0] == passed else 0
            if skip:
                left.append(batch.slice(0, skip))
                n_left += skip
            batch, seeds = batch.slice(skip), seeds[skip:]
            if len(batch):
                last = int(np.searchsorted(seeds, seeds[-1], "left"))
                if last or (held and held[-1]["seed"][0].as_py() != seeds[-1]):
                    whole = pa.concat_batches([*held, batch.slice(0, last)])
                    for lo, hi in _chunks(whole["seed"].to_numpy()):
                        yield _packed(compare_runs(whole.slice(lo, hi - lo), length))
                    held, n_held = [], 0
                held.append(batch.slice(last))
                n_held += len(batch) - last
            if n_held > run_rows:
                passed = seeds[-1]
                left, n_left, held, n_held = left + held, n_left + n_held, [], 0
            if n_left > run_rows:
                yield _packed(pa.concat_batches(left), chunk)
                left, n_left, chunk = [], 0, chunk + 1
            release_memory()
        if left + held:
            yield _packed(pa.concat_batches(left + held), chunk)

    ordered = suffixes.repartitionByRange(parts, "seed", "key", "place").sortWithinPartitions("seed", "key", "place")
    return ordered.mapInArrow(scan, _PACKED)


def _chunks(seed: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole runs of about CHUNK_ROWS rows."""
    begins = np.flatnonzero(~_same_run(seed))
    lo = 0
    while lo < len(seed):
        at = int(np.searchsorted(begins, lo + CHUNK_ROWS, "left"))
        hi = int(begins[at]) if at < len(begins) else len(seed)
        yield lo, hi
        lo = hi


class _Dealt(NamedTuple):
    """A chunk's stretches by bucket and value: distinct ones (groups), and where each row's stretches are among them."""

    rows: pa.RecordBatch
    row: np.ndarray
    start: np.ndarray
    value: np.ndarray  # of each group
    origin: np.ndarray  # the stretch that comes first in order of text and place
    many: np.ndarray  # it has several places in the chunk
    group: np.ndarray  # of each stretch
    cuts: np.ndarray  # where each bucket's groups begin
    buckets: np.ndarray


def _dealt(blob: bytes, buckets: int) -> _Dealt:
    rows = _unpack(blob)
    key = rows["key"].to_numpy()
    row, start, value = _stretches(rows)
    value = _mix(value ^ _mix(rows["seed"].to_numpy().view(np.uint64))[row])
    order = np.lexsort((value, (value >> np.uint64(40)) % np.uint64(buckets)))  # stable: equal ones stay in order of text and place
    v = value[order]
    fresh = np.concatenate([[True], v[1:] != v[:-1]])
    new_place = fresh | np.concatenate([[False], (key[row[order]][1:] != key[row[order]][:-1]) | (start[order][1:] != start[order][:-1])])
    run = np.cumsum(fresh) - 1
    group = np.zeros(len(order), np.int64)
    group[order] = run
    origin = order[fresh]
    to = ((v[fresh] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    return _Dealt(rows, row, start, v[fresh], origin, np.bincount(run, new_place) > 1, group, cuts, to[cuts])


def _resolve_bucket(t: pa.Table) -> pa.Table:
    """Of each chunk's stretches of this bucket: whether they occur again anywhere, and their first place."""
    sizes = [len(b) // 21 for b in (x.as_py() for x in t["blob"])]
    part = lambda kind, at, width: np.concatenate([np.frombuffer(x.as_py()[at * n : (at + width) * n], kind) for x, n in zip(t["blob"], sizes, strict=True)])
    value, key, start, many = part(np.uint64, 0, 8), part(np.int64, 8, 8), part(np.int32, 16, 4), part(np.uint8, 20, 1)
    order = np.lexsort((start, key, value))
    fresh = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    run = np.cumsum(fresh) - 1
    new_place = fresh | np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (start[order][1:] != start[order][:-1])])
    again, at = np.zeros(len(order), np.uint8), np.zeros(len(order), np.int64)
    again[order] = ((np.bincount(run, new_place) > 1) | (np.bincount(run, many[order]) > 0))[run]
    at[order] = order[fresh][run]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blobs = [key[at[a:b]].tobytes() + start[at[a:b]].tobytes() + again[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"chunk": t["chunk"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "blob": pa.array(blobs, pa.binary())})


def _put_together(length: int, buckets: int):
    def unit(t: pa.Table) -> pa.Table:
        answers = {}
        for bucket, blob in zip(t["bucket"].to_pylist(), t["blob"], strict=True):
            if bucket < 0:
                d = _dealt(blob.as_py(), buckets)
            else:
                answers[bucket] = blob.as_py()
        key, start, again = [], [], []
        for bucket in d.buckets.tolist():
            b = answers[bucket]
            n = len(b) // 13
            key.append(np.frombuffer(b[: 8 * n], np.int64))
            start.append(np.frombuffer(b[8 * n : 12 * n], np.int32))
            again.append(np.frombuffer(b[12 * n :], np.uint8))
        key, start, again = (np.concatenate(x) for x in (key, start, again))
        columns = _told(d.rows["key"].to_numpy(), d.rows["words"].to_numpy(), d.row, d.start, again[d.group] > 0, key[d.group], start[d.group], length)
        return pa.table({"blob": pa.array([_pack(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_TOLD_NAMES))], pa.binary())})

    return unit


def _by_stretches(left: DataFrame, length: int) -> DataFrame:
    """(blob): packed passages and heads of the chunks that were left.

    A chunk asks about each of its distinct stretches once, in one packed array
    a bucket, so what many texts share is summed up before it is dealt; buckets
    are of bounded size, and there are as many as it takes.
    """
    buckets = max(1, -(-(left.agg(F.sum("size")).first()[0] or 0) // BUCKET_STRETCHES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["blob"], strict=True):
                d = _dealt(blob.as_py(), buckets)
                key, start = d.rows["key"].to_numpy()[d.row[d.origin]], d.start[d.origin].astype(np.int32)
                ends = np.append(d.cuts[1:], len(d.value))
                blobs = [d.value[a:b].tobytes() + key[a:b].tobytes() + start[a:b].tobytes() + d.many[a:b].astype(np.uint8).tobytes() for a, b in zip(d.cuts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(blobs), pa.int64()), pa.array(d.buckets.astype(np.int32)), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"])
                release_memory()

    schema = "chunk long, bucket int, blob binary"
    answers = left.select("chunk", "blob").mapInArrow(ask, schema).groupBy("bucket").applyInArrow(_resolve_bucket, schema)
    whole = answers.unionByName(left.select("chunk", F.lit(-1).alias("bucket"), "blob"))
    return whole.groupBy("chunk").applyInArrow(_put_together(length, buckets), "blob binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["blob"]:
            yield _unpack(blob.as_py())


def repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED, partition_rows: int = PARTITION_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, copy_of, copy_word): all passages that occur again.

    A passage is a maximal run of words, each of which lies in a stretch of
    ``length`` words that occurs at least twice in the table, in other rows or
    in the same one; words are lower-cased for A-Z and split at blanks, counted
    from 0, with ``end_word`` after the last.  Of the texts that hold the
    passage's first stretch, ``copy_of`` is the smallest doc_id of the one with
    the smallest digest (itself perhaps) and ``copy_word`` the first place
    there.  Null, empty and short texts have no passages.  Repeated rows repeat
    each other; rows with equal text and doc_id are told once.  A null doc_id is
    kept; other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < seed <= length or length - seed >= 1 << _OFFSET_BITS:
        raise ValueError("a passage must hold a kept place")
    key = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("key")
    named = docs.where("text is not null").select("doc_id", key, "text")
    owners = materialize(named.groupBy("key", "doc_id").agg(F.count("*").alias("n")))
    copies = owners.groupBy("key").agg((F.sum("n") > 1).alias("copied"), F.min("doc_id").alias("first_id"))
    suffixes = materialize(_suffixes(named.select("key", "text"), length, seed))
    least_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(_compared(suffixes, max(least_parts, -(-suffixes.count() // partition_rows)), length, run_rows))
    packed = found.where("chunk is null").select("blob").unionByName(_by_stretches(found.where("chunk is not null"), length))
    rows = materialize(packed.mapInArrow(_unpacked, _TOLD))
    w = Window.partitionBy("key").orderBy("start")  # the stretches of one text
    marked = rows.where("not head").withColumn("new", (F.col("start") > F.coalesce(F.lag("stop").over(w), F.lit(-1))).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("copy_key", "copy_word")
    spans = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(at, "start").alias("at")).drop("run")
    # of a text with copies, all words are one passage
    whole = rows.where("head").join(copies.where("copied"), "key").groupBy("key").agg(F.lit(0).alias("start"), F.max("stop").alias("stop"), F.min(at).alias("at"))
    spans = spans.join(copies.where("copied"), "key", "left_anti").unionByName(whole)
    first = copies.select(F.col("key").alias("copy_key"), F.col("first_id").alias("copy_of"))
    told = spans.select("key", "start", "stop", "at.copy_key", "at.copy_word").join(first, "copy_key")
    out = owners.select("key", "doc_id").join(told, "key")
    return out.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "copy_of", F.col("copy_word").cast("long").alias("copy_word"))
