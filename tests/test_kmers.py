import math
from collections import Counter

from braidmill.operators import kmers
from braidmill.streaming.counts import running_counts, stream_reads

READS = ["ACGTACGTNACG", "acgtacgtnacg", "TTTT", "", None, "ACN", "GGGGACGT"]


def naive(k, reads=READS):
    out = Counter()
    for r in reads:
        for i in range(len(r or "") - k + 1):
            w = r[i : i + k].upper()
            if "N" not in w:
                out[w] += 1
    return out


def frame(spark, reads=READS):
    return spark.createDataFrame([(r,) for r in reads], "seq string")


def as_dict(df):
    return {r.kmer: r.cnt for r in df.collect()}


def test_counts(spark):
    assert as_dict(kmers.count_kmers(frame(spark), 3)) == naive(3)


def test_several_lengths_equal_single_ones(spark):
    got = kmers.count_kmers_multi(frame(spark), [5, 3, 2]).collect()
    for k in (5, 3, 2):
        assert {r.kmer: r.cnt for r in got if r.k == k} == naive(k)


def test_canonical_drops_palindromes(spark):
    got = as_dict(kmers.count_canonical(frame(spark), 4))
    comp = str.maketrans("ACGT", "TGCA")
    want = Counter()
    for w, c in naive(4).items():
        r = w.translate(comp)[::-1]
        if r != w:
            want[min(w, r, key=lambda s: s.translate(str.maketrans("ACTG", "0123")))] += c
    assert got == want
    assert "ACGT" in as_dict(kmers.count_canonical(frame(spark), 4, keep_palindromes=True))


def test_derived_counts(spark):
    c = kmers.count_kmers(frame(spark), 3)
    assert sum(r.n * r.abundance for r in kmers.histogram(c).collect()) == sum(naive(3).values())
    assert all(2 <= r.cnt <= 3 for r in kmers.solid(c, 2, 3).collect())
    other = kmers.count_kmers(frame(spark, READS[:1]), 3)
    want = {w: (n, naive(3, READS[:1])[w]) for w, n in naive(3).items() if n != naive(3, READS[:1])[w]}
    assert {r.kmer: (r.cnt_a, r.cnt_b) for r in kmers.differing(c, other).collect()} == want
    assert as_dict(kmers.merge_partial_counts([c, other], 3)) == {w: n for w in naive(3) if (n := naive(3)[w] + naive(3, READS[:1])[w]) >= 3}
    assert as_dict(kmers.later_wins(c, other)) == dict(naive(3)) | dict(naive(3, READS[:1]))


def test_complement_closure(spark):
    got = as_dict(kmers.with_complements(spark.createDataFrame([("AAC", 5), ("GTT", 2), ("CCC", 1)], "kmer string, cnt long")))
    assert got == {"AAC": 5, "GTT": 2, "CCC": 1, "GGG": 1}


def test_sketches(spark):
    values = spark.range(5000).selectExpr("cast(id % 3000 as string) as v")
    r = kmers.linear_count(values, "v", 4096).first()
    assert math.isclose(r.estimate, -4096 * math.log((4096 - r.used) / 4096)) and abs(r.estimate - 3000) < 200 and r.reliable
    assert abs(kmers.approximate_distinct(values, "v").first()[0] - 3000) < 150
    assert {r.level for r in kmers.saturating_counts(spark.range(100).selectExpr("'x' as v"), "v", 4).collect()} == {15}
    assert kmers.read_statistics(frame(spark), 3).first().longest == 12


def test_bloom_filter_misses_nothing(spark):
    put = spark.range(300).selectExpr("cast(id as string) as v")
    asked = spark.range(2000).selectExpr("cast(id as string) as v")
    bloom = kmers.bloom_cells(put, "v", 4096)
    got = {r.v for r in kmers.bloom_filtered(asked, "v", bloom, 4096).collect()}
    assert {str(i) for i in range(300)} <= got and len(got) < 400


def test_order_by_count(spark):
    got = [r.kmer for r in kmers.by_count(spark.createDataFrame([("C", 2), ("B", 1), ("A", 2)], "kmer string, cnt long")).collect()]
    assert got == ["B", "A", "C"]


def test_stream_equals_batch(spark, tmp_path):
    frame(spark).where("seq is not null").write.parquet(str(tmp_path / "in"))
    q = running_counts(stream_reads(spark, str(tmp_path / "in")), 3).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert as_dict(spark.sql("select * from running")) == naive(3)
