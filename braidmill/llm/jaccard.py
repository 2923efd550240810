"""N-gram Jaccard join by grouped prefixes.

Every whole text becomes the set of its distinct word shingles.  All shingles
have one global order, and two sets that reach the threshold share at least one
shingle of their prefixes in this order.  The order is: a fixed share of all
shingles (by hash) first, of these the ones of a single document, then by
document frequency; the other shingles by hash; shingles of hot cells of a
frequency table last.  So the prefix of a text that is mostly its own has
nothing in common with any other.

1. *Prefixes*: frequencies of the first share are counted exactly, in packed
   arrays dealt by hash.  Hot shingles are known from a table of hashed cells
   and never dealt that way.
2. *Collapse*: documents with identical prefixes and set size form one group.
3. *Filter*: the groups of a prefix shingle, in order of set size, are linked
   one to the next unless their sizes alone rule a link out: one edge per
   posting, never all pairs.  The connected components hold every candidate
   pair; postings of hot shingles are salted.  A component comes to one task, or
   in blocks of bounded size to one task a pair of blocks, and there the group
   pairs are formed that share a prefix shingle and whose sizes allow a link.
4. *Expand and verify*: the members of these group pairs, and of each group,
   are compared; no others are.  Tasks return one row per set (links and a
   root), not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap, connected_components, free_name, in_bitmap, materialize, quoted, summed_table
from .textops import SPACE_WORDS, gram_hashes, release_memory, row_blocks, string_buffers, words

#: Cells of the frequency table (more of them where one would hold over CELL_LOAD shingles on average, up to the most);
#: only the order of shingles depends on them.
CELL_BITS, MOST_CELL_BITS, CELL_LOAD = 20, 26, 100_000
#: Cells of the membership bitmap, sixteen for every wanted set between these bounds (1 and 32 MB); false positives only cost time.
BITMAP_BITS, MOST_BITMAP_BITS = 23, 28
#: Most sets and most shingles of one block.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Shingles of a hot cell that one salt stands for.
SALT_ROWS = 100_000
#: Seconds that comparing one pair takes, and one cell of a product of all sets.
PAIR_COST, CELL_COST = 2e-5, 2e-10
#: Of 256, the share of shingles that come first in the global order.
FIRST_SHARE = 104
#: Shingles of that share counted together; there are as many buckets as it takes.
BUCKET_SHINGLES = 1_000_000
CHUNK_BYTES = 2 << 20
#: A set's place in its chunk has 16 bits.
CHUNK_ROWS = 1 << 16
_SEEN = 200_000


def _shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes, for every row."""
    data, offsets = string_buffers(batch["text"])
    for lo, hi in row_blocks(offsets, CHUNK_BYTES):
        _, _, h, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACE_WORDS)
        grams = gram_hashes(h, n)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= n:
                g = np.sort(grams[a : b - n + 1])
                yield lo + i, g[np.concatenate([[True], g[1:] != g[:-1]])]
            else:  # a short text is one shingle, an empty one has none
                yield lo + i, gram_hashes(h[a:b], b - a)


def _digest(values: np.ndarray, salt: int) -> int:
    """64 signed bits that stand for an ordered array of hashes."""
    m = (values ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    m ^= m >> np.uint64(29)
    m *= np.arange(1, 2 * len(m), 2, dtype=np.uint64)
    h = (int(m.sum(dtype=np.uint64)) ^ len(values) * 0xC4CEB9FE1A85EC53) & (1 << 64) - 1
    return h - (h >> 63 << 64)


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def prefix_length(size: int, percent: int) -> int:
    """Two sets that reach the threshold share one of their so many first shingles."""
    return size - -(-size * percent // 100) + 1


def _frequency_table(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        data, offsets = string_buffers(batch["text"])
        for lo, hi in row_blocks(offsets, CHUNK_BYTES):
            h = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACE_WORDS)[2]
            total += np.bincount(_cells(gram_hashes(h, n), bits), minlength=len(total))
        release_memory()

    return summed_table(docs.select("text"), 1 << bits, fill)


def _first_share(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32) & np.uint64(255)) < np.uint64(FIRST_SHARE)


def _column(values: list | np.ndarray, kind: pa.DataType, before: int, after: int) -> pa.Array:
    return pa.concat_arrays([pa.nulls(before, kind), pa.array(values, kind), pa.nulls(after, kind)])


def shingle_classes(docs: DataFrame, n: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(members, postings).

    members(doc_id, row_hash, n_shingles, cid): a row per document; ``cid``
    names the set.  postings(token, salt, cid, size): of all prefixes the
    shingles that more than one document may have.
    """
    sc = docs.sparkSession.sparkContext
    bits, counts = CELL_BITS, _frequency_table(docs, n, CELL_BITS)
    if counts.mean() > CELL_LOAD:
        bits = min(MOST_CELL_BITS, CELL_BITS + math.ceil(math.log2(counts.mean() / CELL_LOAD)))
        counts = _frequency_table(docs, n, bits)
    hot = max(1000, int(counts.mean() * 8))
    buckets = max(8, -(-int(counts.sum()) * FIRST_SHARE // 256 // BUCKET_SHINGLES))
    table = sc.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi in row_blocks(string_buffers(batch["text"])[1], 2 * CHUNK_BYTES):
                for at in range(lo, hi, CHUNK_ROWS):
                    yield from chunk(batch.slice(at, min(CHUNK_ROWS, hi - at)), seen)
            release_memory()

    def chunk(batch: pa.RecordBatch, seen: set[int]) -> Iterator[pa.RecordBatch]:
        sizes, cids, own, firsts = [], [], [], []
        tokens, salts, token_cids, token_sizes = [], [], [], []
        for _, g in _shingle_sets(batch, n):
            sizes.append(len(g))
            cid = _digest(g, 1) ^ len(g) if len(g) else None
            cids.append(cid)
            if cid is None or cid in seen:
                continue
            if len(seen) < _SEEN:
                seen.add(cid)
            cells = table.value[_cells(g, bits)]
            late = cells >= hot
            first = _first_share(g) & ~late
            short = prefix_length(len(g), percent) - int(first.sum())
            own.append((cid, len(g), int(first.sum())))
            firsts.append(g[first])
            if short > 0:  # these come next whatever the frequencies are
                rest = np.flatnonzero(~first)
                order = rest[np.lexsort((g[rest], np.where(late[rest], cells[rest], 0)))][:short]
                tokens.append(g[order])
                salts.append(np.where(late[order], 1 + cid % (1 + cells[order].astype(np.int64) // SALT_ROWS), 0).astype(np.int32))
                token_cids.append(np.full(len(order), cid, np.int64))
                token_sizes.append(np.full(len(order), len(g), np.int32))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        table_of = np.array(own, dtype=np.int64).reshape(-1, 3)
        key = _digest(table_of[:, 0].astype(np.uint64), 3)
        h = cat(firsts, np.uint64)
        of = np.repeat(np.arange(len(own)), [len(x) for x in firsts]).astype(np.uint16)
        to = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        h, of, to = (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), of[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
        parts, blobs = [-1], [table_of.tobytes()]
        for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
            parts.append(int(to[a]))
            blobs.append(of[a:b].tobytes() + h[a:b].tobytes())
        t = cat(tokens, np.uint64).view(np.int64)
        r, k, m = len(batch), len(t), len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch["doc_id"], pa.nulls(k + m, pa.int64())]),
                pa.concat_arrays([batch["row_hash"], pa.nulls(k + m, pa.int64())]),
                _column(np.concatenate([np.array(sizes, np.int32), cat(token_sizes, np.int32)]), pa.int32(), 0, m),
                pa.concat_arrays([pa.array(cids, pa.int64()), pa.array(cat(token_cids, np.int64)), pa.nulls(m, pa.int64())]),
                _column(t, pa.int64(), r, m),
                _column(cat(salts, np.int32), pa.int32(), r, m),
                _column([key] * m, pa.int64(), r + k, 0),
                _column(parts, pa.int32(), r + k, 0),
                _column(blobs, pa.binary(), r + k, 0),
            ],
            names=["doc_id", "row_hash", "size", "cid", "token", "salt", "chunk", "bucket", "blob"],
        )

    schema = "doc_id long, row_hash long, size int, cid long, token long, salt int, chunk long, bucket int, blob binary"
    every = materialize(docs.select(F.col("doc_id").cast("long"), _row_hash(), "text").mapInArrow(split, schema))
    members = every.where("token is null and bucket is null").select("doc_id", "row_hash", F.col("size").cast("long").alias("n_shingles"), "cid")
    packed = every.where("bucket is not null").select("chunk", "bucket", "blob")
    counted = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(_count_bucket, "chunk long, bucket int, blob binary")
    postings = counted.unionByName(packed.where("bucket < 0")).groupBy("chunk").applyInArrow(_choose_prefixes(percent), "token long, salt int, cid long, size int")
    return members, materialize(postings.unionByName(every.where("token is not null").select("token", "salt", "cid", "size")).distinct())


def _count_bucket(t: pa.Table) -> pa.Table:
    """Of each chunk, the shingles of this bucket that occur again: place, shingle, frequency."""
    bucket = t["bucket"][0].as_py()
    blobs = [b.as_py() for b in t["blob"]]
    sizes = [len(b) // 6 for b in blobs]
    rest = np.concatenate([np.frombuffer(b, np.uint32, k, 2 * k) if (2 * k) % 4 == 0 else np.frombuffer(b[2 * k :], np.uint32) for b, k in zip(blobs, sizes, strict=True)])
    of = np.concatenate([np.frombuffer(b, np.uint16, k) for b, k in zip(blobs, sizes, strict=True)])
    row = np.repeat(np.arange(len(blobs)), sizes)
    order = np.argsort(rest, kind="stable")
    value = rest[order]
    run = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1
    count = np.bincount(run)[run]
    again = count > 1
    order, count = order[again], np.minimum(count[again], 65535).astype(np.uint16)
    by_row = np.argsort(row[order], kind="stable")
    order, count = order[by_row], count[by_row]
    ends = np.searchsorted(row[order], np.arange(len(blobs) + 1))
    out = [of[o].tobytes() + count[a:b].tobytes() + rest[o].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True) if (o := order[a:b]) is not None]
    return pa.table({"chunk": t["chunk"].combine_chunks(), "bucket": pa.array([bucket] * len(blobs), pa.int32()), "blob": pa.array(out, pa.binary())})


def _choose_prefixes(percent: int):
    def unit(t: pa.Table) -> pa.Table:
        docs, of, count, token = None, [], [], []
        for bucket, blob in zip(t["bucket"].to_pylist(), t["blob"], strict=True):
            b = blob.as_py()
            if bucket < 0:
                docs = np.frombuffer(b, np.int64).reshape(-1, 3)
            else:
                k = len(b) // 8
                of.append(np.frombuffer(b, np.uint16, k).astype(np.int64))
                count.append(np.frombuffer(b, np.uint16, k, 2 * k).astype(np.int64))
                token.append(np.frombuffer(b, np.uint32, k, 4 * k).astype(np.int64) | bucket << 32)
        if not of or docs is None:
            of, count, token, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros((0, 3), np.int64)
        of, count, token = np.concatenate(of), np.concatenate(count), np.concatenate(token)
        order = np.lexsort((token, count, of))
        of, token = of[order], token[order]
        repeated = np.bincount(of, minlength=len(docs))
        size, first = docs[:, 1], docs[:, 2]
        room = size + (-size * percent) // 100 + 1 - (first - repeated)  # what is left of the prefix after its unique shingles
        rank = np.arange(len(of)) - (np.cumsum(repeated) - repeated)[of]
        keep = rank < room[of]
        of, token = of[keep], token[keep]
        return pa.table({"token": token, "salt": np.zeros(len(of), np.int32), "cid": docs[of, 0], "size": docs[of, 1].astype(np.int32)})

    return unit


def _row_hash():
    return F.xxhash64("doc_id", "text").alias("row_hash")


def _candidate_groups(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(cid, gid, tokens) of all sets with postings, and (gid, cluster) of all groups that may hold a link.

    ``tokens`` are 32 bits of each prefix shingle: enough to tell pairs that share none.
    """
    marks = F.collect_list(F.hash("token")).alias("tokens")
    prefix = postings.groupBy("cid").agg(F.first("size").alias("size"), marks, F.count("*").alias("n"), F.sum(F.xxhash64("token").bitwiseAND(0xFFFFFFFFFF)).alias("a"), F.sum(F.xxhash64("token", F.lit(1)).bitwiseAND(0xFFFFFFFFFF)).alias("b"))
    whole = F.col("n") == F.col("size") + F.floor(-F.col("size") * percent / 100) + 1  # else it has shingles of its own
    groups = materialize(prefix.select("cid", F.when(whole, F.xxhash64("size", "a", "b")).otherwise(F.col("cid")).alias("gid"), "tokens"))
    postings = postings.join(groups.drop("tokens"), "cid").select("token", "salt", "gid", "size").distinct()
    w = Window.partitionBy("token", "salt").orderBy("size", "gid")
    chain = postings.select("*", F.lag("gid").over(w).alias("near"), F.lag("size").over(w).alias("near_size"))
    chain = materialize(chain.where(f"(gid <> near and 100 * near_size >= {percent} * size) or salt > 0"))
    edges = chain.where(f"gid <> near and 100 * near_size >= {percent} * size").select(F.col("gid").alias("a"), F.col("near").alias("b"))
    # across salts: all groups of a band of sizes, and of neighbouring bands
    band = F.floor(F.log(F.col("size")) / math.log(100 / percent)).alias("band")
    tops = chain.where("salt > 0").groupBy("token", "salt", band).agg(F.min("gid").alias("a"))
    band_tops = tops.groupBy("token", "band").agg(F.min("a").alias("b"))
    next_tops = band_tops.select("token", (F.col("band") + 1).alias("band"), F.col("b").alias("a"))
    edges = edges.unionByName(tops.join(band_tops, ["token", "band"]).select("a", "b")).unionByName(next_tops.join(band_tops, ["token", "band"]).select("a", "b"))
    labels = connected_components(edges).select(F.col("node").alias("gid"), F.col("label").alias("cluster"))
    several = groups.groupBy("gid").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
    alone = several.join(labels, "gid", "left_anti").select("gid", F.col("gid").alias("cluster"))
    return groups, labels.unionByName(alone)


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, grams binary) of the documents whose ``cid`` is in the table of those wanted, and a few more."""
    bits = min(MOST_BITMAP_BITS, max(BITMAP_BITS, (16 * wanted.count()).bit_length()))
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("cid"), "cid", bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cids, grams, size = [], [], 0
            for _, g in _shingle_sets(batch, n):
                if len(g):
                    cid = _digest(g, 1) ^ len(g)
                    if cid not in seen and in_bitmap(marks.value, bits, np.array([cid], np.int64).view(np.uint64))[0]:
                        if len(seen) < _SEEN:
                            seen.add(cid)
                        cids.append(cid)
                        grams.append(g.tobytes())
                        size += 8 * len(g)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(grams, pa.binary())], names=["cid", "grams"])
                    cids, grams, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(grams, pa.binary())], names=["cid", "grams"])
            release_memory()

    return docs.select("text").mapInArrow(emit, "cid long, grams binary")


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a dense matrix; shingles in blocks."""
    k = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    ids = np.cumsum(fresh) - 1
    shared = np.bincount(ids)[ids] > 1
    ids, owner = ids[shared], owner[shared]
    out = np.zeros((k, k), dtype=np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    if not len(ids):
        return out
    ids = np.cumsum(np.concatenate([[False], ids[1:] != ids[:-1]]))
    width = max(256, (1 << 21) // k)
    for lo in range(0, int(ids[-1]) + 1, width):
        a, b = np.searchsorted(ids, [lo, lo + width])
        m = np.zeros((k, min(width, int(ids[-1]) + 1 - lo)), dtype=np.float32)
        m[owner[a:b], ids[a:b] - lo] = 1
        out += m @ m.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index of a symmetric boolean matrix."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.int32(len(label))).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sharing(tokens: list[np.ndarray]) -> np.ndarray:
    """Which of the groups share a prefix shingle (or seem to, by 32 bits of it)."""
    if not sum(map(len, tokens)):
        return np.zeros((len(tokens), len(tokens)), dtype=bool)
    return _common_counts([np.unique(t) for t in tokens]) > 0


def group_pairs(gid: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], block: np.ndarray, crossing: bool, percent: int) -> np.ndarray:
    """Pairs of sets to verify, as a matrix: those of one group, and of groups that share a prefix shingle and whose sizes allow a link.

    ``crossing`` leaves out pairs of one block; they belong to that block's own unit.
    """
    _, at, of = np.unique(gid, return_index=True, return_inverse=True)
    fits = _sharing([tokens[i] for i in at])
    np.fill_diagonal(fits, True)
    enough = np.greater_equal.outer(100 * size[at], percent * size[at])
    fits &= enough
    fits &= enough.T
    del enough
    pairs = fits[np.ix_(of, of)]
    if crossing:
        pairs &= block[:, None] != block[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def _verified(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs reach the threshold; one by one where they are few."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    x, y = np.nonzero(np.triu(pairs))
    linked = np.zeros_like(pairs)
    if len(x) * PAIR_COST < CELL_COST * len(sets) ** 2 * max(256, int(size.sum()) // 4):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            linked[i, j] = linked[j, i] = 100 * common >= percent * (size[i] + size[j] - common)
        return linked
    some = np.flatnonzero(pairs.any(axis=1))
    common = _common_counts([sets[i] for i in some])
    for lo in range(0, len(some), 256):  # in bands, since the sums are wide
        rows = some[lo : lo + 256]
        c = common[lo : lo + 256].astype(np.int64)
        linked[np.ix_(rows, some)] = (100 + percent) * c >= percent * (size[rows][:, None] + size[some][None, :])
    linked &= pairs
    return linked


def _verify(percent: int):
    def unit(t: pa.Table) -> pa.Table:
        cid, at = np.unique(t["cid"].to_numpy(), return_index=True)
        t = t.take(pa.array(at))
        weight, block = t["copies"].to_numpy(), t["block"].to_numpy()
        tokens = [np.array(x, np.int32) for x in t["tokens"].to_pylist()]
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t["grams"]]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        pairs = group_pairs(t["gid"].to_numpy(), size, tokens, block, t["i"][0].as_py() != t["j"][0].as_py(), percent)
        linked = _verified(sets, pairs, percent)
        root = _roots(linked)
        del sets, pairs
        release_memory()
        return pa.table({"cid": cid, "root": cid[root], "links": (linked @ weight).astype(np.int64)})

    return unit


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """members with label (the component's smallest cid), component_id and n_links."""
    members, postings = shingle_classes(docs, n, percent)
    groups, clusters = _candidate_groups(postings, percent)
    classes = materialize(members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size")))
    wanted = materialize(classes.join(groups.join(clusters, "gid").select("cid", "gid", "tokens", "cluster"), "cid").select("cid", "gid", "tokens", "cluster", "copies", "size"))
    extent = wanted.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles")).where("sets > 1")
    extent = extent.select("cluster", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = materialize(wanted.join(extent, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    sets = _sets_of(docs, placed, n).join(placed, "cid")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("cid", "gid", "tokens", "grams", "copies", "block", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = materialize(units.groupBy("cluster", "i", "j").applyInArrow(_verify(percent), "cid long, root long, links long"))
    labels = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "label")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(labels, "cid", "left").join(links, "cid", "left")
    named = materialize(named.select("cid", "first_id", "copies", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    firsts = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    final = named.join(firsts, "label").select("cid", "label", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    rest = members.drop("cid").where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("n_shingles > 0").join(final, "cid").drop("cid").unionByName(rest)


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs(doc_id, text)``.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets
    of distinct n-word shingles; a text of fewer words is one shingle.
    ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the
    number of other rows linked with this one, equal texts included.  Null and
    empty texts, and texts of separators only, have no shingles and no links;
    their component is their own doc_id.  Repeated rows are rows of their own;
    a null doc_id is never smallest unless all are null.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    return _joined(docs.select("doc_id", "text"), n, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays.

    It is the row with the smallest doc_id (null last), then the smallest hash;
    of wholly equal (doc_id, text) rows any one stays.  Rows without links stay.
    All columns of ``docs`` are returned as they are.
    """
    linked = materialize(_joined(docs.select("doc_id", "text"), n, percent).where("n_links > 0").select("label", "doc_id", "row_hash"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    first = materialize(linked.groupBy("label").agg(F.min_by("row_hash", rank).alias("first_hash")))
    marked = linked.join(first, "label")  # two plain tables: a join that can be split where one component holds most rows
    name = free_name(docs.columns, "bm_row_hash")
    gone = materialize(marked.where("row_hash <> first_hash").select(F.col("row_hash").alias(name)).distinct())
    twice = materialize(marked.where("row_hash = first_hash").groupBy(F.col("row_hash").alias(name)).count().where("count > 1").select(name))
    kept = docs.withColumn(name, F.xxhash64("doc_id", "text")).join(gone, name, "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, name, "left_anti").unionByName(kept.join(twice, name, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*map(quoted, docs.columns))
