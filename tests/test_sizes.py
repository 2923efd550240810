"""What a task holds does not grow with the table; results do not change with the number of parts."""

import random

import pytest
from pyspark.sql import functions as F

from braidmill import session
from braidmill.operators import beam, kmers, likelihood, pairs, sketches
from braidmill.plans import fixtures as X
from braidmill.plans import round_trips

PATHS = [("a", [1, 2, 3, 2]), ("b", [2, 3]), ("b", [3, 2, 3]), ("c", []), ("d", [5])]


def _pairs(path: list[int]) -> set[tuple[int, int]]:
    return {(v, w) for i, v in enumerate(path) for w in path[i:]}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_path_are_distinct_without_being_gathered(spark):
    paths = spark.createDataFrame(PATHS, "path_id string, nodes array<long>")
    rows = likelihood.path_pairs(paths)
    want = {(name, *pair) for name in "abcd" for p, nodes in PATHS if p == name for pair in _pairs(nodes)}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    assert all("v1#" not in x for x in _plan(rows).splitlines() if "Exchange" in x)


@pytest.mark.parametrize("penalty", ["weighted", "flat"])
def test_more_pairs_take_more_tasks(spark, monkeypatch, penalty):
    monkeypatch.setattr(session, "TASK_ROWS", 3)
    paths = spark.createDataFrame([(p, nodes) for p, nodes in PATHS if p != "b"], "path_id string, nodes array<long>")
    sets = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "d"), ("t", "d")], "set_id string, path_id string")
    rows = likelihood.pair_multiplicity(sets, paths)
    assert rows.rdd.getNumPartitions() == 4  # of 10 + 0 + 1 pairs, 3 each
    assert {tuple(r) for r in rows.collect()} >= {("s", 5, 5, 1), ("t", 5, 5, 1), ("s", 1, 2, 2)}
    pairs = spark.createDataFrame([(1, 2, 7, 40), (2, 3, 5, 41), (5, 5, 2, 30), (9, 9, 4, 30)], "v1 long, v2 long, cnt long, span long")
    one = likelihood.set_likelihood(sets, paths, pairs, 1000, penalty)
    few = {r["removed"]: r for r in likelihood.leave_one_out(paths, pairs, 1000, penalty).collect()}
    without_a = spark.createDataFrame([("x", "c"), ("x", "d")], "set_id string, path_id string")
    again = likelihood.set_likelihood(without_a, paths, pairs, 1000, penalty).first()
    assert few["a"]["loglik"] == pytest.approx(again["loglik"]) and few["a"]["missed"] == pytest.approx(again["missed"])
    assert {r["set_id"]: r["size"] for r in one.collect()} == {"s": 2, "t": 1}


def test_traces_are_ranked_in_ranges(spark, sf_dir, monkeypatch):
    whole = {tuple(r) for r in X._run(spark, sf_dir, f"with {X._bound(X.TRACE.format(text='string'))} select * from trace", "orders").collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = X.trace(spark, sf_dir)
    assert "Window" not in _plan(rows) and "SinglePartition" not in _plan(rows)
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(whole) and set(got) == whole
    empty = session.numbered(spark.createDataFrame([], "x long"), 0, "n", F.asc("x"))
    assert empty.count() == 0 and empty.columns == ["x", "n"]


def test_items_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    tables = {"item_edges": (X.item_edges, X.ITEM_EDGES), "item_vertices": (X.item_vertices, X.ITEM_VERTICES), "item_places": (X.item_places, X.ITEM_PLACE), "item_support": (X.item_support, X.ITEM_SUPPORT)}
    whole = {name: {tuple(r) for r in X._run(spark, sf_dir, f"with {X._bound(X.ITEMS)}, {cte.format(text='string')} select * from {name}", "lineitem").collect()} for name, (_, cte) in tables.items()}
    monkeypatch.setattr(session, "TASK_ROWS", 600)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name, (f, _) in tables.items():
        got = [tuple(r) for r in f(spark, sf_dir).collect()]
        assert len(got) == len(whole[name]) and set(got) == whole[name], name
    assert X.item_vertices(spark, sf_dir).rdd.getNumPartitions() == -(-n // 600)


READS = [("ACGTNACGGT", "TTACGA"), ("ACGTNACGGT", "TTACGA"), ("GGTTAC", None), ("acgtac", "CCGTA")]


def test_pairs_that_were_counted_before_give_the_same(spark):
    whole = spark.createDataFrame(READS, "r1 string, r2 string")
    counted = pairs.counted_pairs(whole)
    assert counted.count() == 3 and "times" in counted.columns
    one = lambda rows: rows.select(F.explode(F.array("r1", "r2")).alias("seq"), *[c for c in rows.columns if c == "times"])
    for f in (lambda p: kmers.count_kmers_multi(one(p), [4, 3]), lambda p: pairs.pair_support(p, kmers.count_kmers(one(p), 3), 3, 0, 0, 1)):
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(f(counted)) == rows(f(whole)) != []


@pytest.mark.parametrize("least", [1, 3, 20])
def test_words_with_times_are_gated_alike(spark, least):
    words = spark.createDataFrame([("AAC", 2), ("AAC", 1), ("CCG", 400), ("GGT", 1)], "kmer string, times long")
    got = {r.kmer: r.cnt for r in sketches.gated_counts(words, sketches.Shape(sketches.BUCKET, 2), least).collect()}
    assert got == {k: n for k, n in {"AAC": 3, "CCG": 400, "GGT": 1}.items() if n >= least}


def test_paired_files_are_written_in_ranges(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    monkeypatch.setattr(round_trips, "_text", lambda rows, *lines: written.append(_plan(rows)))
    monkeypatch.setattr(round_trips.files, "read_paired_files", lambda *a: None)
    round_trips.file_paired_reads(spark, sf_dir)
    assert len(written) == 2 and all("Coalesce 1" not in p and "rangepartitioning" in p for p in written)


@pytest.mark.parametrize(("backward", "normalized"), [(True, False), (False, True)])
def test_maps_and_joins_of_partners_score_alike(spark, monkeypatch, backward, normalized):
    layers_ = spark.createDataFrame([(v, 2 * v, d) for v, d in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 3))], "vid long, depth int, layer int")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    support = spark.createDataFrame([(1, 2, 3), (1, 4, 5), (2, 4, 1), (3, 5, 2), (2, 5, 7)], "v1 long, v2 long, cnt long")
    weighted = beam.weighted_support(support, support.where("cnt > 4").select("v1", "v2"), normalized)
    joins, by_joins, seen = [], beam._scored_by_joins, []
    monkeypatch.setattr(beam, "_scored_by_joins", lambda *a: joins.append(1) or by_joins(*a))
    for most in (256, 1, 0):
        monkeypatch.setattr(beam, "MAP_PARTNERS", most)
        rows = beam.sub_paths(layers_, edges, weighted, 3, 5, normalized, backward)
        seen.append(sorted((r.vid, r.rank, tuple(r.nodes), r.score) for r in rows.collect()))
        assert bool(joins) == (most < 256)
    assert seen[0] == seen[1] == seen[2] != []


def _small_graph(spark):
    placed = spark.createDataFrame([(v, 2 * v, d) for v, d in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 3))], "vid long, depth int, layer int")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)], "src long, dst long")
    support = spark.createDataFrame([(1, 2, 3, True), (1, 4, 5, False), (2, 4, 1, False), (3, 5, 2, True), (2, 5, 7, False)], "v1 long, v2 long, cnt long, bubble boolean")
    return placed, edges, support


@pytest.mark.parametrize("backward", [True, False])
def test_laws_share_a_sweep_and_only_far_messages_are_written(spark, monkeypatch, backward):
    """Edges to the next layer are followed where it is solved; of the six edges one goes further."""
    placed, edges, support = _small_graph(spark)
    written, add = [], session.Stepwise.add
    monkeypatch.setattr(session.Stepwise, "add", lambda self, rows: written.append([tuple(r) for r in rows.select("via", "dst").distinct().collect()] if "via" in self.schema.names else "") or add(self, rows))
    laws = (False, True)
    both = beam.sub_paths_by_laws(placed, edges, beam.weighed(support, laws), 3, 5, laws, backward)
    got = sorted((r.law, r.vid, r["rank"], tuple(r.nodes), r.score) for r in both.collect())
    assert [w for w in written if w] == [[(5, 1) if backward else (1, 5)]]
    want = []
    for law, normalized in enumerate(laws):
        weighted = beam.weighted_support(support.drop("bubble"), support.where("bubble").select("v1", "v2"), normalized)
        rows = beam.sub_paths(placed, edges, weighted, 3, 5, normalized, backward).collect()
        want += [(law, r.vid, r["rank"], tuple(r.nodes), r.score) for r in rows]
    assert got == sorted(want) and len({r[0] for r in got}) == 2


def test_links_hold_support_and_edges_of_one_pass(spark, sf_dir):
    links = X.item_links(spark, sf_dir)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(links.selectExpr("v1", "v2", "cnt", "cast(bubble as int)")) == rows(X.item_support(spark, sf_dir))
    assert rows(links.where("next").select("v1", "v2")) == rows(X.item_edges(spark, sf_dir)) != []
    weighed = _plan(beam.weighed(links, (False, True)))
    assert weighed.count("Exchange") == _plan(links).count("Exchange")  # the rows of a vertex lie together already


def test_held_edges_are_not_moved_by_joins(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    kept = session.held(edges, 3, "src")
    rows = kept.join(spark.createDataFrame([(1,), (7,)], "src long").hint("merge"), "src")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2), (1, 3)]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Sort [src") <= 2
    kept.unpersist()


def test_ways_are_judged_by_heads_and_tails_before_they_are_combined(spark):
    rng = random.Random(5)
    ahead, back = set(), set()
    for v in range(40):
        ahead |= {(v, (*(rng.randrange(2) for _ in range(rng.randrange(4))), 100 + v)) for _ in range(4)}
        back |= {(v, (100 + v, *(rng.randrange(2) for _ in range(rng.randrange(4))))) for _ in range(4)}
    ranked = lambda paths: [(v, i, list(p), i / 8) for v in range(40) for i, (_, p) in enumerate(sorted((x for x in sorted(paths) if x[0] == v), key=lambda _: rng.random()))]
    up, down = ranked(ahead), ranked(back)
    want = set()
    for v, i, h, _ in up:
        for w, j, t, _ in down:
            inside = any(a == v and b == v and (x, y) < (i, j) and p[-len(h) :] == h and q[: len(t)] == t for a, x, p, _ in up for b, y, q, _ in down) if v == w else True
            if not inside and len(h) + len(t) > 2:
                want.add((v, i, j, tuple(h + t[1:])))
    frame = lambda rows: spark.createDataFrame(rows, "vid long, rank int, nodes array<long>, score double")
    rows = beam.ways_through(spark.range(40).withColumnRenamed("id", "vid"), frame(up), frame(down))
    assert {(r.vid, r["head"], r["tail"], tuple(r.nodes)) for r in rows.collect()} == want and len(want) > 100
    above = _plan(rows).split("Generate")[0]
    assert "exists" not in above  # no check of one way against all others of its vertex


def test_rows_of_one_number_are_put_without_a_sort(spark):
    table = session.Stepwise(spark, "a long")
    table.put(spark.range(3).withColumnRenamed("id", "a"), 2)
    table.put(spark.range(1).withColumnRenamed("id", "a"), 5)
    assert table.has(2) and not table.has(3)
    assert sorted(tuple(r) for r in table.all().collect()) == [(0, 2), (0, 5), (1, 2), (2, 2)] and table.step(2).count() == 3
