import numpy as np
import pytest

from braidmill.llm import jaccard

from .helpers import components, documents, odd_documents, same, shingles


def test_equals_brute_force(spark):
    rows = odd_documents()
    same(jaccard.ngram_jaccard_join(documents(spark, rows)).collect(), components(rows))


@pytest.mark.parametrize("blocks", [True, False])
def test_blocks_and_salts_change_nothing(spark, monkeypatch, blocks):
    """Tiny blocks, everything hot, few buckets: the same rows."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3 if blocks else 512)
    monkeypatch.setattr(jaccard, "FIRST_SHARE", 20)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 2000)
    rows = odd_documents(5)
    table = jaccard._frequency_table
    monkeypatch.setattr(jaccard, "SALT_ROWS", 200)
    monkeypatch.setattr(jaccard, "_frequency_table", lambda d, n, bits: table(d, n, bits) + (2000 if not blocks else 0))
    monkeypatch.setattr(jaccard, "PAIR_COST", 1e3 if blocks else 1e-12)
    monkeypatch.setattr(jaccard, "CELL_LOAD", 1e-4 if blocks else 1e9)
    same(jaccard.ngram_jaccard_join(documents(spark, rows)).collect(), components(rows))


@pytest.mark.parametrize("least, most", [(7, 7), (7, 28)])
def test_the_bitmap_grows_with_what_is_wanted(spark, monkeypatch, least, most):
    """A full bitmap lets everything through, a fitting one hardly any set; the rows are the same."""
    asked = []
    build = jaccard.bitmap
    monkeypatch.setattr(jaccard, "bitmap", lambda df, column, bits: asked.append(bits) or build(df, column, bits))
    monkeypatch.setattr(jaccard, "BITMAP_BITS", least)
    monkeypatch.setattr(jaccard, "MOST_BITMAP_BITS", most)
    rows = odd_documents(6)
    same(jaccard.ngram_jaccard_join(documents(spark, rows)).collect(), components(rows))
    assert asked == [7] if most == 7 else asked[0] > 7


def test_empty_table(spark):
    assert jaccard.ngram_jaccard_join(documents(spark, [(1, "x")]).limit(0)).collect() == []
    assert jaccard.keep_one_per_component(documents(spark, [(1, "x")]).limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    kept = jaccard.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    parts = {}
    for row, (d, n, c, links) in zip(rows, components(rows), strict=True):
        parts.setdefault(("lone", d, row[1]) if not links else c, []).append(row)
    want = []
    for k, members in parts.items():
        if isinstance(k, tuple):
            want += members
        else:
            want.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    # of several texts with the smallest id any may stay
    same([(d, len(shingles(t)) > 0) for d, t in got], [(d, len(shingles(t)) > 0) for d, t in want])


@pytest.mark.parametrize("few", [True, False])
def test_only_group_pairs_are_verified(monkeypatch, few):
    """Groups share a prefix shingle and have fitting sizes; members of a group are compared with each other."""
    monkeypatch.setattr(jaccard, "PAIR_COST", 0.0 if few else 1e3)
    gid = np.array([5, 5, 7, 8, 9])
    size = np.array([10, 10, 11, 11, 40])
    tokens = [np.array(x, np.int32) for x in ([1, 2], [1, 2], [2, 3], [4], [1])]
    pairs = jaccard.group_pairs(gid, size, tokens, np.zeros(5), False, 75)
    assert {(i, j) for i, j in zip(*np.nonzero(pairs), strict=True) if i < j} == {(0, 1), (0, 2), (1, 2)}
    crossing = jaccard.group_pairs(gid, size, tokens, np.array([0, 1, 0, 0, 0]), True, 75)
    assert {(i, j) for i, j in zip(*np.nonzero(crossing), strict=True) if i < j} == {(0, 1), (1, 2)}
    sets = [np.arange(a, a + 10, dtype=np.uint64) for a in (0, 1, 5, 0, 0)]
    linked = jaccard._verified(sets, pairs, 75)
    assert {(i, j) for i, j in zip(*np.nonzero(linked), strict=True) if i < j} == {(0, 1)}  # (0, 3) are equal, but no pair


def test_columns_called_like_internal_ones_stay(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 5), (2, text, 6), (3, "else", 7)], "doc_id long, text string, bm_row_hash int")
    assert sorted(map(tuple, jaccard.keep_one_per_component(docs).collect())) == [(1, text, 5), (3, "else", 7)]


def test_prefix_length():
    for n in range(1, 60):
        p = jaccard.prefix_length(n, 75)
        assert n - p + 1 >= 0.75 * n > n - p  # what is left out cannot reach the threshold


def test_places_beyond_16_bits(spark):
    """More rows in a chunk than 16 bits count: the last ones keep their links."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        texts = "case when id < 65600 then concat('f', id) else concat(concat_ws(' ', transform(sequence(0, 18), x -> concat(x, '_', id div 2))), ' end', id) end"
        rows = spark.range(0, 66000, 1, 1).selectExpr("id as doc_id", f"{texts} as text")
        got = jaccard.ngram_jaccard_join(rows).where("n_links > 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    same([(r.doc_id, r.component_id, r.n_links) for r in got], [(i, i // 2 * 2, 1) for i in range(65600, 66000)])
