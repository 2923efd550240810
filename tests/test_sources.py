import gzip
import struct

from braidmill.operators import graph
from braidmill.plans import fixtures as X
from braidmill.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta_and_lists(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two\nacg\nTTT\n>next\nGG\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAC\nGT\n")
    assert rows(files.read_fasta(spark, str(tmp_path / "a.fa"))) == [("next", "GG"), ("one two", "ACGTTT")]
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa.gz\n")
    assert rows(files.read_sequences(spark, str(tmp_path / "list"))) == [("next", "GG"), ("one two", "ACGTTT"), ("z", "ACGT")]
    assert files.sample_of_files(list("abc")) == ["a"]


def test_a_long_file_is_no_list(spark, tmp_path):
    import pytest

    (tmp_path / "x").write_text("ACGT\n" * (files.MOST_FILES + 1))
    with pytest.raises(ValueError, match="neither FASTA nor FASTQ"):
        files.read_sequences(spark, str(tmp_path / "x"))


def test_fastq_and_pairs(spark, tmp_path):
    (tmp_path / "1.fq").write_text("@r1\nACGT\n+\n@@@@\n@r2\nTTTT\n+r2\n+III\n")
    (tmp_path / "2.fq").write_text("@r1\nCCCC\n+\nIIII\n@r2\nGGGG\n+\nIIII\n")
    assert rows(files.read_fastq(spark, str(tmp_path / "1.fq"))) == [("r1", "ACGT", "@@@@"), ("r2", "TTTT", "+III")]
    assert rows(files.read_paired_files(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"))) == [(0, "ACGT", "CCCC"), (1, "TTTT", "GGGG")]
    (tmp_path / "p.fa").write_text(">a\nAA\n>a\nCC\n>b\nGG\n>b\nTT\n")
    assert rows(files.read_interleaved_pairs(spark, str(tmp_path / "p.fa"))) == [(0, "AA", "CC"), (1, "GG", "TT")]


def test_places_over_many_files_and_blocks(spark, tmp_path):
    """Files in order of name, whatever their sizes, and blocks of a file in order."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        folder = tmp_path / "reads"
        folder.mkdir()
        names = []
        for f, n in enumerate([3, 90, 1, 40]):
            text = "".join(f"@r{f}_{i}\n{'ACGT'[i % 4] * (5 + i % 9)}\n+\n{'I' * (5 + i % 9)}\n" for i in range(n))
            (folder / f"{f}.fq").write_text(text)
            names += [f"r{f}_{i}" for i in range(n)]
        got = files._fastq(spark, str(folder)).orderBy("at").collect()
        assert [r.id for r in got] == names and [r["at"] for r in got] == list(range(len(names)))
        assert files.read_fastq(spark, [str(folder / "0.fq"), str(folder / "1.fq")]).count() == 93
        plan = files.read_fastq(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ExistingRDD") == 1 and "ExistingRDD[bm_file" in plan  # the blocks; lines never leave the JVM
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_tables_round_trip(spark, tmp_path):
    k = spark.createDataFrame([(3, "AAC", 5), (3, "CCC", 1)], "k int, kmer string, cnt long")
    sinks.write_kmer_text(k, str(tmp_path / "k"))
    assert rows(files.read_kmer_counts(spark, str(tmp_path / "k"))) == [("AAC", 5), ("CCC", 1)]
    assert rows(files.read_kmer_counts(spark, str(tmp_path / "k"), 1, True)) == [("AAC", 5), ("GTT", 5)]
    sinks.write_kmer_counts(k, str(tmp_path / "kp"))
    assert spark.read.parquet(str(tmp_path / "kp")).count() == 2
    g = X.small_graph(spark)
    sinks.write_condensed_graph(g["unitigs"], g["edges"], str(tmp_path / "g"))
    u, e = files.read_condensed_graph(spark, str(tmp_path / "g"))
    assert rows(u.select("vid", "seq")) == sorted(X.UNITIG_ROWS) and rows(e) == sorted(X.EDGE_ROWS)
    vertices = spark.createDataFrame([(v, d) for v, d in {r[:2] for r in X.COMPAT_ROWS} | {r[2:4] for r in X.COMPAT_ROWS}], "vid long, depth int")
    sinks.write_support_lists(g["compat"].select("v1", "v2", "cnt"), vertices, str(tmp_path / "c"))
    assert rows(files.read_support_lists(spark, str(tmp_path / "c"))) == sorted(X.COMPAT_ROWS)
    assert rows(files.read_support_lists(spark, str(tmp_path / "c"), True)) == sorted(r for r in X.COMPAT_ROWS if r[3] >= r[1])


def test_paths_trace_sam_and_sets(spark, tmp_path):
    paths = spark.createDataFrame([(7, 0.5, [1, 4], [3, 5], "ACGT", 4)], "path_id int, score double, nodes array<long>, depths array<int>, seq string, len int")
    line = sinks.path_lines(paths).first().value
    assert line == "1:1 3 2:4 5\n>0.5>7__4\nACGT"
    (tmp_path / "p").write_text("\n".join(line.split("\n")[:2]) + "\n")
    assert rows(files.read_paths(spark, str(tmp_path / "p"))) == [("0.5>7", ">0.5>7__4", [1, 4], [3, 5])]
    assert files.read_paths(spark, str(tmp_path / "p"), False).first().path_id == "7"
    (tmp_path / "s").write_text("@HD\tx\n" + "\t".join(["q__9", "16", "r", "5", "0", "*", "*", "0", "0", "A", "I", "NM:i:3"]) + "\n")
    assert rows(files.read_sam(spark, str(tmp_path / "s"))) == [("q__9", 16, "r", 5, 3)]
    (tmp_path / "t").write_text("1 -2.5 0.9>8 0.01\n")
    assert rows(files.read_trace(spark, str(tmp_path / "t"))) == [(1, -2.5, "0.9>8", 0.01)]
    (tmp_path / "sets").write_text("1,2\n2, 3\n\n1,2\n")
    assert rows(files.read_candidate_sets(spark, str(tmp_path / "sets"))) == [(0, "1"), (0, "2"), (1, "2"), (1, "3"), (2, "1"), (2, "2")]
    (tmp_path / "ks").write_text("61\n60\n")
    assert files.read_k_values(spark, str(tmp_path / "ks")) == [61, 60]
    (tmp_path / "so").write_text("ACG\nCCC\n")
    assert rows(files.read_start_order(spark, str(tmp_path / "so"))) == [("ACG", 0), ("CCC", 1)]


def test_packed_counts(spark, tmp_path):
    def pack(s):
        n = 0
        for c in s:
            n = n * 4 + "ACTG".index(c)
        return n.to_bytes(8, "little")

    body = struct.pack("<ii", 64, 5) + b"".join(pack(s) + struct.pack("<I", n) for s, n in (("ACGTT", 3), ("GGGGA", 1)))
    (tmp_path / "c.bin").write_bytes(body)
    assert rows(files.read_packed_counts(spark, str(tmp_path / "c.bin"))) == [(5, "ACGTT", 3), (5, "GGGGA", 1)]
    assert rows(files.read_packed_counts(spark, str(tmp_path / "c.bin"), 2)) == [(5, "ACGTT", 3)]


def test_fastg(spark, tmp_path):
    g = X.small_graph(spark)
    sinks.write_fastg(g["unitigs"], g["edges"], 4, str(tmp_path / "f"))
    text = {r.value for r in spark.read.text(str(tmp_path / "f")).collect()}
    assert ">NODE_0_length_9_cov_1.0:NODE_1_length_6_cov_1.0,NODE_2_length_6_cov_1.0;" in text
    assert "ACGTACGGA" in text and "TTC" in text
    assert graph.fastg_lines(g["unitigs"], g["edges"], 4).count() == 9


def test_command_line(spark, tmp_path):
    from braidmill.__main__ import main

    genome = "ACGTTGCAAGGCTATTCCGATCAGGTACCATGAAACCGTCTTGA"
    comp = str.maketrans("ACGT", "TGCA")
    reads = "".join(f">r{i}\n{genome[i : i + 16]}\n>r{i}\n{genome[i + 8 : i + 24].translate(comp)[::-1]}\n" for i in range(20) for _ in range(4))
    (tmp_path / "r.fa").write_text(reads)
    main(["--fas", str(tmp_path / "r.fa"), "-k", "9", "--IS", "30", "--GL", "44", "--pair-threshold", "0", "--out", str(tmp_path / "out")])
    found = {r.seq for r in spark.read.parquet(str(tmp_path / "out/final")).collect()}
    assert genome[:43] in found or any(genome[:43] in s for s in found)
    assert any(r.value.startswith(">") for r in spark.read.text(str(tmp_path / "out/final.fasta")).collect())


def test_stages_of_the_command_line(spark, tmp_path):
    """Counting to FASTG, and likelihood, elimination and the final set of given paths."""
    from braidmill.__main__ import main
    from braidmill.operators import likelihood

    at = lambda name: str(tmp_path / name)
    (tmp_path / "r.fa").write_text(">a\nACGTTGCAAGGC\n>b\nACGTTGCATGGC\n")
    main(["count", "--reads", at("r.fa"), "-k", "6", "5", "--out", at("n")])
    assert dict(rows(files.read_kmer_counts(spark, at("n/5"))))["ACGTT"] == 2
    main(["count", "--reads", at("r.fa"), "-k", "5", "--least", "2", "--canonical", "--out", at("c")])
    assert all(n >= 2 for _, n in rows(files.read_kmer_counts(spark, at("c/5"))))
    main(["edges", "--kmers", at("n/5"), "--k1mers", at("n/6"), "-k", "5", "--out", at("e")])
    assert ("ACGTT", "CGTTG") in rows(files.read_edges(spark, at("e")))
    main(["condense", "--edges", at("e"), "--kmers", at("n/5"), "-k", "5", "--out", at("g")])
    unitigs, edges = files.read_condensed_graph(spark, at("g"))
    assert unitigs.count() > 1 and edges.count() > 0
    main(["prune", "--condensed", at("g"), "--kmers", at("n/5"), "-k", "5", "--least", "1.5", "--all", "--out", at("p")])
    assert 0 < files.read_condensed_graph(spark, at("p"))[0].count() < unitigs.count()
    main(["fastg", "--condensed", at("g"), "-k", "5", "--out", at("f")])
    assert spark.read.text(at("f")).where("value like '>NODE%'").count() == unitigs.count()
    g = X.small_graph(spark)
    sinks.write_condensed_graph(g["unitigs"], g["edges"], at("sg"))
    lines = {}
    for v1, d1, v2, d2, n in X.COMPAT_ROWS:
        lines.setdefault(f"{v1}:{d1}", []).append(f"{v2}:{d2}:{n}")
    (tmp_path / "s").write_text("".join(f"{head} {' '.join(m)}\n" for head, m in lines.items()))
    (tmp_path / "paths").write_text("".join(" ".join(f"{i + 1}:{v} 0" for i, v in enumerate(nodes)) + f"\n>1.0>{p}__9\n" for p, nodes in X.PATH_ROWS))
    (tmp_path / "sets").write_text("0,1\n2\n")
    given = ["--condensed", at("sg"), "--compat", at("s"), "--paths", at("paths"), "--ids-only"]
    main(["support", "--compat", at("s"), "--threshold", "20", "--out", at("s20")])
    assert {r.cnt for r in files.read_support_lists(spark, at("s20")).collect()} == {r[4] for r in X.COMPAT_ROWS if r[4] > 20}
    main(["sets", *given, "--sets", at("sets"), "--genome", "60", "--out", at("ll")])
    pairs = likelihood.oriented(g["compat"], files.read_condensed_graph(spark, at("sg"))[0].select("vid", "len"))
    sets = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "set_id long, path_id int")
    want = {r.set_id: (r["size"], round(r.loglik, 3)) for r in likelihood.set_likelihood(sets, g["paths"], pairs, 60).collect()}
    got = spark.read.schema("set_id long, size int, loglik double, missed double").csv(at("ll"), sep=" ").collect()
    assert {r.set_id: (r["size"], round(r.loglik, 3)) for r in got} == want
    main(["eliminate", *given, "--genome", "60", "--out", at("t")])
    trace = files.read_trace(spark, at("t"))
    assert [r.removed for r in likelihood.elimination(g["paths"], pairs, 60).orderBy("step").collect()] == [r.removed for r in trace.orderBy("size", ascending=False).collect()]
    main(["final", "--condensed", at("sg"), "--paths", at("paths"), "--trace", at("t"), "-k", "4", "--ids-only", "--out", at("fa")])
    assert 0 < files.read_fasta(spark, at("fa")).count() <= 4
