import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidmill.functions import sequences as S
from braidmill.plans import fixtures as X
from braidmill.plans.registry import variant_identity

COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rc(s):
    return "".join(COMPLEMENT.get(c, "N") for c in reversed(s))


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "s string").select(*columns).first())


def test_complements(spark):
    s = F.col("s")
    got = one(spark, "ACGNTx", S.revcomp(s), S.revcomp_n_to_c(s), S.revcomp_keep(s))
    assert got == ("NANCGT", "CACCGT", "xANCGT")


def test_kmers_and_segments(spark):
    s = F.col("s")
    assert one(spark, "ACGT", S.kmer_array(s, 3))[0] == ["ACG", "CGT"]
    assert one(spark, "AC", S.kmer_array(s, 3))[0] == []
    assert one(spark, "NNACNNNGN", S.segments(s))[0] == ["AC", "G"]
    assert one(spark, "ACGTAC", S.prefix(s, 2), S.suffix(s, 2), S.last_base(s), S.column_slice(s, 2, 3)) == ("AC", "AC", "C", "CG")


def test_packing_is_ordered_and_reversible(spark):
    rows = [("".join(t),) for t in ("AAAA", "ACGT", "TTTT", "GGGG", "CATG")]
    got = spark.createDataFrame(rows, "s string").select("s", S.pack(F.col("s")).alias("p"), S.unpack(S.pack(F.col("s")), 4).alias("u")).collect()
    assert all(r.s == r.u for r in got)
    by_number = [r.s for r in sorted(got, key=lambda r: r.p)]
    assert by_number == sorted((r.s for r in got), key=lambda s: ["ACTG".index(c) for c in s])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ACGT", min_size=6, max_size=6), min_size=1, max_size=20))
def test_canonical(spark, kmers):
    got = spark.createDataFrame([(k,) for k in kmers], "s string").select("s", S.canonical(F.col("s")).alias("c"), S.canonical_text(F.col("s")).alias("t"), S.revcomp(F.col("s")).alias("r")).collect()
    for r in got:
        key = lambda s: ["ACTG".index(c) for c in s]
        assert r.r == rc(r.s)
        assert r.c == min(r.s, rc(r.s), key=key)
        assert r.t == min(r.s, rc(r.s))


def test_packed_complement(spark):
    p = S.pack(F.col("s"))
    assert one(spark, "AACGT", S.unpack(S.revcomp_packed(p, 5), 5))[0] == "ACGTT"


def test_extension_and_k(spark):
    base, strand = S.extend_canonical(F.col("s"), F.lit("A"))
    assert one(spark, "TTTC", base, strand) == ("TTCA", 0)
    assert one(spark, "GTTT", base, strand) == ("TAAA", 1)
    assert one(spark, "AGGG", *S.extend_canonical(F.col("s"), F.lit("G"))) == ("CCCC", 1)
    assert one(spark, "ACGTA", S.largest_k(F.length("s"), [3, 5, 7]))[0] == 5


def test_global_identity(spark):
    rows = [("ACGT", "ACGT"), ("ACGT", "AGT"), ("", "A"), (None, "A")]
    got = spark.createDataFrame(rows, "a string, b string").select(S.global_identity("a", "b")).collect()
    assert [r[0] for r in got] == [1.0, 0.75, None, None]


def plain_identity(a, b):
    row = [(-5 * j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (-5 * i, 0)
        for j, y in enumerate(b, 1):
            options = ((diagonal[0] + (10 if x == y else -5), diagonal[1] + (x == y)), (row[j][0] - 5, row[j][1]), (row[j - 1][0] - 5, row[j - 1][1]))
            diagonal, row[j] = row[j], max(options, key=lambda o: o[0])
    return row[-1][1] / len(a)


def test_identity_by_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT"[: 1 + k % 4]) for _ in range(rng.randrange(1, 40))) for k in range(40)] + ["A", "é𝄞A"]
    for a in texts:
        for b in [*rng.sample(texts, 8), "", a[3:] + "A"]:
            assert S._identity(a, b) == plain_identity(a, b), (a, b)


def test_variants_are_aligned_whole(spark, sf_dir):
    seqs = {r.hap_id: r.seq for r in X.genome(spark, sf_dir).collect()}
    got = {(r.hap_id, r.other_id): r.identity for r in variant_identity(spark, sf_dir).collect()}
    assert got == {(a, b): plain_identity(seqs[a], seqs[b]) for a in seqs for b in seqs if a < b}


def test_stitch(spark):
    got = spark.createDataFrame([(["ACGTA", "GTACC", "ACCT"],)], "s array<string>").select(S.stitch(F.col("s"), 4)).first()[0]
    assert got == "ACGTA" + "CC" + "T"


def test_wide_packing(spark):
    import random

    rng = random.Random(4)
    comp = str.maketrans("ACGT", "TGCA")
    for k in (5, 31, 32, 55, 70):
        rows = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(40)]
        df = spark.createDataFrame([(x,) for x in rows], "s string").withColumn("p", S.pack_wide(F.col("s"), k))
        got = df.select("s", "p", S.unpack_wide(F.col("p"), k).alias("u"), S.unpack_wide(S.revcomp_packed_wide(F.col("p"), k), k).alias("r")).collect()
        assert all(r.u == r.s and r.r == r.s.translate(comp)[::-1] for r in got)
        order = str.maketrans("ACTG", "0123")
        assert [r.s for r in sorted(got, key=lambda r: r.p)] == sorted(rows, key=lambda x: x.translate(order))
