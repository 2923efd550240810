import hashlib
import random
from collections import Counter

import pytest

from braidmill.operators import sketches as K


def frame(spark, words):
    return spark.createDataFrame([(w, 1) for w in words], "kmer string, other int")


def words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(n)]


def plain_cells(word, shape):
    d = hashlib.md5(word.encode()).hexdigest()
    one, two = int(d[:15], 16) % shape.cells, int(d[16:31], 16) % shape.cells
    return [(one + i * two) % shape.cells for i in range(shape.hashes)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_bloom_filter(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    inside, outside = words(8000, 1), words(20_000, 2)
    shape = K.shape_for(8000, 0.05)
    bloom = K.bloom_filter(frame(spark, [*inside, None]), "kmer", shape)
    assert bloom.count() <= shape.cells // K.BUCKET
    rows = K.with_membership(frame(spark, [*inside, None]), "kmer", bloom, shape).collect()
    assert len(rows) == 8001 and {(r.kmer is None, r.held) for r in rows} == {(False, True), (True, None)}  # none is missed
    set_ = {c for w in inside for c in plain_cells(w, shape)}
    got = K.with_membership(frame(spark, outside), "kmer", bloom, shape).collect()
    assert all(r.held == (set_ >= set(plain_cells(r.kmer, shape))) for r in got)
    others = [r.held for r in got if r.kmer not in set(inside)]
    rate = sum(others) / len(others)
    assert abs(rate / K.expected_rate(len(set(inside)), shape) - 1) < 0.2


def test_filters_are_merged(spark):
    shape = K.Shape(2 * K.BUCKET, 3)
    a, b = words(900, 3), words(900, 4)
    merged = K.merged_blooms(K.bloom_filter(frame(spark, a), "kmer", shape), K.bloom_filter(frame(spark, b), "kmer", shape))
    whole = K.bloom_filter(frame(spark, a + b), "kmer", shape)
    assert sorted((r.bucket, bytes(r.bits)) for r in merged.collect()) == sorted((r.bucket, bytes(r.bits)) for r in whole.collect())
    empty = K.bloom_filter(frame(spark, []), "kmer", shape)
    assert empty.count() == 0 and not any(r.held for r in K.with_membership(frame(spark, a), "kmer", empty, shape).collect())


@pytest.mark.parametrize("bits, broadcast", [(4, True), (3, True), (2, False), (1, True)])
def test_counters_stop_at_their_top_and_never_fall_short(spark, monkeypatch, bits, broadcast):
    if not broadcast:
        monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    rng, top = random.Random(bits), (1 << bits) - 1
    stock = words(500, 5)
    seen = [w for w in stock for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 20, 300]))]
    rng.shuffle(seen)
    shape, truth = K.Shape(K.BUCKET, 3), Counter(seen)
    counters = K.saturating_counters(frame(spark, [*seen, None]).repartition(7), "kmer", shape, bits)
    cells = Counter(c for w in seen for c in plain_cells(w, shape))
    rows = K.with_levels(frame(spark, [*stock, "absent", None]), "kmer", counters, shape).collect()
    for r in rows:
        if r.kmer is None:
            assert r.level is None
        else:
            assert r.level == min(top, *(cells[c] for c in plain_cells(r.kmer, shape))) >= min(top, truth[r.kmer])
    exact = sum(r.level == min(top, truth[r.kmer]) for r in rows if r.kmer in truth)
    assert exact > 0.97 * len(set(stock))  # a cell is shared with probability 3 * 500 / 32,768
    few = {r.kmer for r in K.occurring(frame(spark, stock), "kmer", counters, shape, min(top, 2)).collect()}
    assert few >= {w for w, n in truth.items() if n >= 2}


@pytest.mark.parametrize("least", [1, 2, 3, 20])
def test_gated_counts_are_exact(spark, least):
    rng = random.Random(least)
    seen = [w for w in words(300, 6) for _ in range(rng.choice([1, 1, 1, 1, 2, 3, 20, 21, 40]))]
    want = {w: n for w, n in Counter(seen).items() if n >= least}
    for shape in (K.Shape(K.BUCKET, 4), K.Shape(K.BUCKET, 16)):
        assert {r.kmer: r.cnt for r in K.gated_counts(frame(spark, seen), shape, least).collect()} == want
    assert K.gated_counts(frame(spark, []), K.Shape(K.BUCKET, 2), least).collect() == []


def test_the_gate_holds_back_what_is_seen_once(spark):
    seen = words(20_000, 7) + words(200, 8) * 5
    shape = K.shape_for(20_200, 0.01)
    counters = K.saturating_counters(frame(spark, seen), "kmer", shape, 2)
    passed = K.occurring(frame(spark, seen), "kmer", counters, shape, 2).count()
    assert 1000 <= passed < 0.1 * len(seen)


def test_distinct_sketches_are_merged(spark):
    rows = [(w, b) for b in range(5) for w in words(3000, 20 + b // 2)]
    values = spark.createDataFrame(rows, "kmer string, batch int")
    kept = K.distinct_sketches(values, "kmer", "batch")
    assert kept.count() == 5
    truth = len({w for w, _ in rows})
    assert abs(K.distinct_of(kept).first()[0] / truth - 1) < 0.05
    two = kept.where("batch < 2")
    assert abs(K.distinct_of(two).first()[0] / 3000 - 1) < 0.05


def test_batches_are_read_until_the_estimate_is_steady(spark):
    batches = [frame(spark, words(2000, s)) for s in (1, 2, 1, 3, 4)]
    got = K.distinct_until_steady(batches, "kmer").first()
    assert (got.batches, got.steady) == (3, True) and abs(got.distinct_about / 4000 - 1) < 0.05
    got = K.distinct_until_steady(batches[:2], "kmer").first()
    assert (got.batches, got.steady) == (2, False)
    assert K.distinct_until_steady([frame(spark, []), frame(spark, [])], "kmer").first().distinct_about == 0
    with pytest.raises(ValueError):
        K.distinct_until_steady([], "kmer")


def test_shapes():
    for n, rate in ((0, 0.5), (1, 0.01), (10**6, 0.001), (10**9, 0.02)):
        shape = K.shape_for(n, rate)
        assert shape.cells % K.BUCKET == 0 and 1 <= shape.hashes <= 16 and K.expected_rate(n, shape) <= rate * 1.05
    for bad in ((-1, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            K.shape_for(*bad)
