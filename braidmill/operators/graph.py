"""De Bruijn graphs: edges, degrees, unitigs, and pruning of the contracted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.functions import sequences as S
from braidmill.session import Stepwise, materialize

#: Edges of a contracted graph that the driver walks itself; larger ones are walked by joins.
DRIVER_EDGES = 200_000


def _known(kmers: DataFrame, threshold: int, both_strands: bool) -> DataFrame:
    out = kmers.where(F.col("cnt") > threshold).select("kmer")
    if both_strands:
        out = out.unionByName(out.select(S.revcomp(F.col("kmer")).alias("kmer")))
    return out.distinct()


def _both_ends(edges: DataFrame, known: DataFrame) -> DataFrame:
    return edges.join(known.withColumnRenamed("kmer", "u"), "u", "left_semi").join(known.withColumnRenamed("kmer", "v"), "v", "left_semi").select("u", "v")


def _with_reverse(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(S.revcomp(F.col("v")).alias("u"), S.revcomp(F.col("u")).alias("v"))).distinct()


def edges_from_k1mers(k1mers: DataFrame, kmers: DataFrame, k: int, threshold: int = 0) -> DataFrame:
    """edges(u, v) from the distinct (k+1)-mers: first k letters to last k, and the reverse complement.

    Both ends, on either strand, must be seen more than ``threshold`` times.
    """
    words = k1mers.where(S.has_no_n(F.col("kmer"))).select(S.prefix(F.col("kmer"), k).alias("u"), S.suffix(F.col("kmer"), k).alias("v"))
    return _with_reverse(_both_ends(words, _known(kmers, threshold, True)))


def edges_from_reads(reads: DataFrame, kmers: DataFrame, k: int, threshold: int = 0) -> DataFrame:
    """edges(u, v) from neighbouring k-mers of the reads."""
    words = reads.select(F.upper("seq").alias("seq")).distinct().select(F.explode(S.kmer_array(F.col("seq"), k + 1)).alias("kmer")).distinct()
    return edges_from_k1mers(words, kmers, k, threshold)


def filter_edges(edges: DataFrame, kmers: DataFrame, threshold: int = 0, strand_tolerant: bool = False) -> DataFrame:
    """Edges both of whose ends are k-mers above the threshold (or their complements are)."""
    return _both_ends(edges, _known(kmers, threshold, strand_tolerant))


def degrees(edges: DataFrame) -> DataFrame:
    """(kmer, n_in, n_out)"""
    ends = edges.select(F.col("u").alias("kmer"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("v").alias("kmer"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("kmer").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("kmer")).join(edges.select(F.col("v").alias("kmer")), "kmer", "left_anti").distinct()


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("kmer")).join(edges.select(F.col("u").alias("kmer")), "kmer", "left_anti").distinct()


def internal_edges(edges: DataFrame) -> DataFrame:
    """Edges whose tail has no other successor and whose head no other predecessor."""
    one_out = edges.groupBy("u").agg(F.count("*").alias("n"), F.first("v").alias("v")).where("n = 1").select("u", "v")
    one_in = edges.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    return one_out.join(one_in, "v", "left_semi").where("u <> v")


def unitig_starts(edges: DataFrame) -> DataFrame:
    """K-mers at which a maximal unbranched stretch begins."""
    nodes = edges.select(F.col("u").alias("kmer")).unionByName(edges.select(F.col("v").alias("kmer"))).distinct()
    return nodes.join(internal_edges(edges).select(F.col("v").alias("kmer")), "kmer", "left_anti")


def unitig_members(edges: DataFrame) -> DataFrame:
    """(kmer, root, offset): each k-mer's unitig, named by its first k-mer.

    Pointers to the predecessor double their reach in each join, so a stretch
    of n k-mers takes log2(n) joins.  Rings without a beginning drop out.
    """
    starts = materialize(unitig_starts(edges))
    back = internal_edges(edges).select(F.col("v").alias("kmer"), F.col("u").alias("to"), F.lit(1).cast("long").alias("far"))
    state = materialize(starts.select("kmer", F.col("kmer").alias("to"), F.lit(0).cast("long").alias("far")).unionByName(back))
    n, reach = state.agg(F.count("*"), F.sum("far")).first()
    for _ in range(n.bit_length() // 2 + 1):
        for _ in range(2):
            ahead = state.select(F.col("kmer").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
            state = state.join(ahead, "to").select("kmer", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"))
        state, before = materialize(state), reach
        reach = state.agg(F.sum("far")).first()[0]
        if reach == before:  # all pointers have arrived
            break
    roots = starts.withColumnRenamed("kmer", "to")
    return state.join(roots, "to", "left_semi").select("kmer", F.col("to").alias("root"), F.col("far").cast("int").alias("offset"))


def unitigs(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(unitigs, cond_edges) of all parts of the graph that a source reaches.

    unitigs(vid, seq, len, prefix, suffix): ``vid`` is the hash of the first
    k-mer.  cond_edges(src, dst).
    """
    edges = materialize(edges)  # read by several steps
    members = unitig_members(edges)
    rows = members.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("offset", S.last_base(F.col("kmer")).alias("b")))).alias("bases"))
    seq = F.concat("root", F.array_join(F.transform(F.slice("bases", F.lit(2), F.size("bases")), lambda x: x["b"]), ""))
    rows = rows.select(F.xxhash64("root").alias("vid"), seq.alias("seq"))
    rows = materialize(rows.select("vid", "seq", F.length("seq").alias("len"), S.prefix(F.col("seq"), k).alias("prefix"), S.suffix(F.col("seq"), k).alias("suffix")))
    cond = materialize(condensed_edges(rows, edges))
    reached = reachable(rows, cond)
    return rows.join(reached, "vid", "left_semi"), cond.join(reached.withColumnRenamed("vid", "src"), "src", "left_semi")


def condensed_edges(unitig_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): the last k-mer of one unitig leads to the first of the other."""
    tails = unitig_rows.select(F.col("suffix").alias("u"), F.col("vid").alias("src"))
    heads = unitig_rows.select(F.col("prefix").alias("v"), F.col("vid").alias("dst"))
    return edges.join(tails, "u").join(heads, "v").select("src", "dst")


def vertex_sources(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    return vertices.select("vid").join(cond.select(F.col("dst").alias("vid")), "vid", "left_anti")


def vertex_sinks(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    return vertices.select("vid").join(cond.select(F.col("src").alias("vid")), "vid", "left_anti")


def reachable(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    """(vid) of all vertices that some source reaches."""
    begin = vertex_sources(vertices, cond)
    if cond.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        nearby: dict[int, list[int]] = {}
        for r in cond.collect():
            nearby.setdefault(r["src"], []).append(r["dst"])
        seen = set(nearby) - {v for heads in nearby.values() for v in heads}  # sources with edges; the others reach only themselves
        todo = list(seen)
        while todo:
            for v in nearby.get(todo.pop(), []):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        walked = vertices.sparkSession.createDataFrame([(v,) for v in sorted(seen)], "vid long")
        return walked.unionByName(begin).distinct()
    seen, front, level = Stepwise(vertices.sparkSession, "vid long", "level"), materialize(begin), 0
    while not front.isEmpty():
        seen.add(front.withColumn("level", F.lit(level)))  # fronts only: no vertex is written twice
        front = materialize(cond.join(front.withColumnRenamed("vid", "src"), "src").select(F.col("dst").alias("vid")).distinct().join(seen.all().select("vid"), "vid", "left_anti"))
        level += 1
    return seen.all().select("vid")


def kmer_vertices(unitig_rows: DataFrame, k: int) -> DataFrame:
    """(kmer, vid, offset)"""
    return unitig_rows.select("vid", F.posexplode(S.kmer_array(F.col("seq"), k)).alias("offset", "kmer")).select("kmer", "vid", "offset")


def unitig_coverage(unitig_rows: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(vid, n_kmers, coverage): mean count of a unitig's k-mers; unknown ones count 0."""
    placed = kmer_vertices(unitig_rows, k).join(kmers.select("kmer", "cnt"), "kmer", "left")
    return placed.groupBy("vid").agg(F.count("*").alias("n_kmers"), (F.sum(F.coalesce("cnt", F.lit(0))) / F.count("*")).alias("coverage"))


def prune(vertices: DataFrame, cond: DataFrame, coverage: DataFrame, least: float, everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without the tips (or all vertices) whose mean coverage is below ``least``; edges need both ends."""
    low = coverage.where(F.col("coverage") < least).select("vid")
    if not everywhere:
        low = low.join(vertex_sources(vertices, cond).unionByName(vertex_sinks(vertices, cond)).distinct(), "vid", "left_semi")
    kept = vertices.join(low, "vid", "left_anti")
    return kept, keep_edges(kept, cond)


def keep_edges(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    ids = vertices.select("vid")
    return cond.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").select("src", "dst")


def graph_summary(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    """(n_vertices, n_edges, n_sources, n_sinks)"""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(vertices, "n_vertices")
    for df, name in ((cond, "n_edges"), (vertex_sources(vertices, cond), "n_sources"), (vertex_sinks(vertices, cond), "n_sinks")):
        out = out.crossJoin(count(df, name))  # one row each
    return out


def edit_summary(vertices: DataFrame, cond: DataFrame, kept: DataFrame, kept_cond: DataFrame) -> DataFrame:
    """``graph_summary`` of what an edit has kept, plus (n_removed, n_lost_edges): vertices and edges that went."""
    gone = vertices.select("vid").join(kept.select("vid"), "vid", "left_anti").agg(F.count("*").alias("n_removed"))
    lost = cond.select("src", "dst").join(kept_cond, ["src", "dst"], "left_anti").agg(F.count("*").alias("n_lost_edges"))
    return graph_summary(kept, kept_cond).crossJoin(gone).crossJoin(lost)  # one row each


def strand_twins(unitig_rows: DataFrame) -> DataFrame:
    """(vid, twin): the unitig with the reverse-complemented sequence."""
    other = unitig_rows.select(F.col("vid").alias("twin"), F.col("seq").alias("rc"))
    return unitig_rows.select("vid", S.revcomp(F.col("seq")).alias("rc")).join(other, "rc").select("vid", "twin")


def fastg_lines(unitig_rows: DataFrame, cond: DataFrame, k: int) -> DataFrame:
    """(vid, header, seq): nodes with their successors; all but sources lose the first k - 1 bases."""
    name = lambda v, n: F.concat(F.lit("NODE_"), v.cast("string"), F.lit("_length_"), n.cast("string"), F.lit("_cov_1.0"))
    rows = unitig_rows.select("vid", "seq", F.length("seq").alias("n"))
    heads = cond.distinct().join(rows.select(F.col("vid").alias("dst"), F.col("n").alias("dst_n")), "dst")
    out = heads.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("dst", "dst_n"))).alias("to"))
    with_in = cond.select(F.col("dst").alias("vid")).distinct().withColumn("fed", F.lit(True))
    joined = rows.join(out, "vid", "left").join(with_in, "vid", "left")
    tail = F.when(F.col("to").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.array_join(F.transform("to", lambda x: name(x["dst"], x["dst_n"])), ",")))
    return joined.select("vid", F.concat(F.lit(">"), name(F.col("vid"), F.col("n")), tail, F.lit(";")).alias("header"), F.when(F.col("fed"), F.substring("seq", F.lit(k), F.col("n"))).otherwise(F.col("seq")).alias("seq"))
