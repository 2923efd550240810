"""The bounded best-path cover of an acyclic graph, layer by layer.

Every vertex keeps its best ``beam`` sub-paths to the sinks and from the
sources.  A sub-path goes as a message to the neighbours of its end; there it is
scored by a join with the support between the vertex and the sub-path's nodes,
and ranked among the candidates of the vertex.  The cover has the sub-paths of
all sources, then ways through what these leave out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidmill.session import Stepwise, materialize

from .layers import DRIVER_EDGES, by_layer, layered_edges, sweep

#: Share of the best score that a kept sub-path reaches.
CUTOFF = 0.25
#: Ways up and down that are combined at a vertex that is left out.
EACH = 10
#: Partners of a vertex that are kept as a map in its row; more are joined pair by pair.
MAP_PARTNERS = 256
_PATH = "law int, rank int, nodes array<long>, depths array<long>, score double"


def weighed(support: DataFrame, laws: tuple[bool, ...]) -> DataFrame:
    """``support(v1, v2, cnt, bubble)`` plus ``shares``: for each law a pair's count by the number of partners of v1, or (normalized) by their summed counts."""
    each = Window.partitionBy("v1")
    partners = [(F.sum("cnt") if normalized else F.count("*")).over(each).cast("double") for normalized in laws]
    return support.withColumn("shares", F.array(*[F.col("cnt").cast("double") / n for n in partners]))


def _marked(support: DataFrame, bubble: DataFrame) -> DataFrame:
    marked = bubble.select("v1", "v2").distinct().withColumn("bubble", F.lit(True))
    return support.join(marked, ["v1", "v2"], "left").select("v1", "v2", "cnt", F.coalesce("bubble", F.lit(False)).alias("bubble"))


def weighted_support(support: DataFrame, bubble: DataFrame, normalized: bool) -> DataFrame:
    """(v1, v2, share, bubble): support weighed by one law."""
    return weighed(_marked(support, bubble), (normalized,)).select("v1", "v2", F.col("shares")[0].alias("share"), "bubble")


def _gains(laws: tuple[bool, ...], backward: bool) -> Column:
    """What a supported node adds to a sub-path's score: for each law, as a near one and as a far one, by share and bubble."""
    gains = []
    for i, normalized in enumerate(laws):
        share = F.col("shares")[i]
        single = share if backward and not normalized else F.lit(1.0)
        for held in (F.when(F.col("bubble"), F.lit(2.0)).otherwise(single), F.when(F.col("bubble"), F.lit(1.0)).otherwise(F.lit(0.5))):
            gains.append(held * share if normalized else held)
    return F.array(*gains)


def _gain(near: Column, nodes: Column, gains: Column) -> Column:
    """What a node adds; ``gains`` is null without support."""
    mine = 2 * F.col("law")
    return F.when(near, F.coalesce(F.get(gains, mine), -nodes.cast("double"))).otherwise(F.coalesce(F.get(gains, mine + 1), F.lit(0.01)))


def _valued(rows: DataFrame, total: Column, held: Column, backward: bool) -> DataFrame:
    """What candidates are worth by the sum of their gains; nodes with support are named where this is nothing."""
    c = F.col("c").cast("double")
    value = 2 * total / (c * (c + 1))
    value = F.when(c > 1, value).otherwise(total) if backward else F.least(F.lit(1.0), value)
    return rows.withColumn("value", value).select("vid", "depth", "law", "nodes", "depths", "value", F.when(F.col("value") == 0, held).alias("held"))


def _sized(candidates: DataFrame, backward: bool) -> DataFrame:
    """candidates plus ``c`` and what the gains of their nodes are added to, in the order of the path."""
    c = F.col("c").cast("double")
    begin = F.col("score") * c * (c - 1) / 2
    begin = F.when(c == 1, F.col("score")).otherwise(begin) if backward else begin
    return candidates.withColumn("c", F.size("nodes") if backward else F.size("nodes") + 1).withColumn("begin", begin)


def _scored(candidates: DataFrame, insert: int, backward: bool) -> DataFrame:
    """candidates plus value and, of the nodes, those supported; the partners of the vertex are a map in the row."""
    partner = lambda node: F.try_element_at("partners", node)

    def gain(node: Column, i: Column) -> Column:
        away = F.get("depths", i) - F.col("depth") if backward else F.col("depth") - F.get("depths", i)
        return _gain(away < insert, F.col("c"), partner(node))

    total = F.aggregate(F.transform("nodes", gain), F.col("begin"), lambda t, g: t + g)
    return _valued(_sized(candidates, backward), total, F.filter("nodes", lambda node: partner(node).isNotNull()), backward)


def _scored_by_joins(candidates: DataFrame, support: DataFrame, insert: int, backward: bool) -> DataFrame:
    """The same for vertices with too many partners for a map: every node meets its support (own, other, gains) in a join."""
    key = ["vid", "law", "via", "rank"]
    candidates = _sized(candidates, backward).drop("partners")
    nodes = candidates.select(*key, "depth", "c", F.posexplode(F.arrays_zip("nodes", "depths")).alias("place", "at")).select(*key, "depth", "c", "place", F.col("at.nodes").alias("node"), F.col("at.depths").alias("node_depth"))
    away = F.col("node_depth") - F.col("depth") if backward else F.col("depth") - F.col("node_depth")
    gains = nodes.join(support.withColumnRenamed("own", "vid").withColumnRenamed("other", "node"), ["vid", "node"], "left")
    gains = gains.select(*key, "place", _gain(away < insert, F.col("c"), F.col("gains")).alias("gain"), F.when(F.col("gains").isNotNull(), F.col("node")).alias("held"))
    summed = gains.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "gain", "held"))).alias("gains"))
    total = F.aggregate("gains", F.col("begin"), lambda t, g: t + g["gain"])
    held = F.filter(F.transform("gains", lambda g: g["held"]), lambda n: n.isNotNull())
    return _valued(candidates.join(summed, key), total, held, backward)


def _ranked(scored: DataFrame, backward: bool) -> DataFrame:
    """Candidates with their rank at the vertex and its best value; backward also the ``zeros``, those worth 0 that ``_fresh`` chooses from."""
    order = Window.partitionBy("vid", "law").orderBy(F.desc("value"), "nodes")
    more = {"rank": F.row_number().over(order) - 1, "best": F.first("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    if backward:
        zero = F.when((F.col("value") == 0) & _may_be_fresh(), F.struct("nodes", "depths", "held"))
        scored, more["zeros"] = scored.withColumn("zero", zero).drop("held"), F.collect_list("zero").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scored.withColumns(more)


def _may_be_fresh() -> Column:
    return (F.size("held") > 0) | (F.size("nodes") < 2)


def _fresh(zeros: Column, beam: int) -> Column:
    """Of candidates (nodes, depths, held) that are all worth 0, in the order of their nodes, those that are short or support a node that no kept one supports."""
    kept = "array<struct<nodes: array<bigint>, depths: array<bigint>>>"
    start = F.struct(F.array().cast("array<bigint>").alias("covered"), F.array().cast(kept).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        more = F.struct(F.array_union(a["covered"], x["held"]).alias("covered"), F.concat(a["kept"], F.array(F.struct(x["nodes"].alias("nodes"), x["depths"].alias("depths")))).alias("kept"))
        takes = (F.size(a["kept"]) < beam) & ((F.size(F.array_except(x["held"], a["covered"])) > 0) | (F.size(x["nodes"]) < 2))
        return F.when(takes, more).otherwise(a)

    return F.aggregate(F.array_sort(zeros), start, step, lambda a: a["kept"])


def _fresh_only(zeros: DataFrame, beam: int) -> DataFrame:
    """What ``_fresh`` chooses from the rows of each vertex."""
    folded = zeros.where(_may_be_fresh()).groupBy("vid", "depth").agg(_fresh(F.collect_list(F.struct("nodes", "depths", "held")), beam).alias("kept"))
    return folded.select("vid", "depth", F.posexplode("kept").alias("rank", "p")).select("vid", "depth", "rank", "p.nodes", "p.depths", F.lit(0.0).alias("score"))


def _partners(layers: DataFrame, support: DataFrame) -> DataFrame:
    """``layers`` plus ``partners``, a map of the vertex's support (own, other, gains), and ``many``, true where this would be too large and is left out."""
    order = Window.partitionBy("own").orderBy("other")
    rows = support.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    entry = F.when(F.col("n") <= MAP_PARTNERS, F.struct("other", "gains"))
    rows = rows.select("own", "place", "n", entry.alias("entry")).withColumn("entries", F.collect_list("entry").over(Window.partitionBy("own")))  # MAP_PARTNERS at most
    maps = rows.where("place = 1").select(F.col("own").alias("vid"), F.map_from_entries("entries").alias("partners"), (F.col("n") > MAP_PARTNERS).alias("many"))
    return layers.join(maps, "vid", "left").withColumn("many", F.coalesce("many", F.lit(False)))


def sub_paths(layers: DataFrame, cond: DataFrame, support: DataFrame, beam: int, insert: int, normalized: bool, backward: bool) -> DataFrame:
    """(vid, rank, nodes, depths, score, layer): the kept sub-paths by one law; ``support`` is that of ``weighted_support``."""
    shares = support.select("v1", "v2", F.array("share").alias("shares"), "bubble")
    return sub_paths_by_laws(layers, cond, shares, beam, insert, (normalized,), backward).drop("law")


def sub_paths_by_laws(layers: DataFrame, cond: DataFrame, support: DataFrame, beam: int, insert: int, laws: tuple[bool, ...], backward: bool) -> DataFrame:
    """(vid, law, rank, nodes, depths, score, layer): the kept sub-paths of every vertex, to the sinks (backward) or from the sources.

    ``layers`` has vid, depth and layer, ``support`` has v1, v2, bubble and,
    in ``shares``, a weight for each of the laws, which share all joins; ``law``
    counts them from 0.  Ranks run from 0 by falling score, ties by nodes.
    Backward a vertex without a kept candidate keeps itself alone; forward only
    sources do, and a vertex all of whose candidates are below the cutoff keeps
    nothing, nor do those that it alone leads to.
    """
    own, other = ("v1", "v2") if backward else ("v2", "v1")
    support = support.select(F.col(own).alias("own"), F.col(other).alias("other"), _gains(laws, backward).alias("gains"))
    placed = by_layer(_partners(layers.select("vid", "depth", "layer"), support))
    many = placed.all().where("many").select(F.col("vid").alias("own"), "layer")
    if any_many := not many.isEmpty():
        table = Stepwise(layers.sparkSession, "own long, other long, gains array<double>")
        table.add(support.join(many, "own"))

    def scored(candidates: DataFrame, layer: int) -> DataFrame:
        if not any_many:
            return _scored(candidates, insert, backward)
        by_map = _scored(candidates.where("not many or nodes is null"), insert, backward)
        return by_map.unionByName(_scored_by_joins(candidates.where("many and nodes is not null"), table.step(layer), insert, backward))

    def path(law: Column, rank: Column, nodes: Column, depths: Column, score: Column) -> Column:
        parts = {"law": law.cast("int"), "rank": rank.cast("int"), "nodes": nodes, "depths": depths, "score": score}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    vid, depth = F.array("vid"), F.array(F.col("depth").cast("long"))
    alone = lambda law: path(law, F.lit(0), vid, depth, F.lit(0.0))
    each_alone = F.array(*[alone(F.lit(i)) for i in range(len(laws))])

    def solve(rows: DataFrame, inbox: DataFrame, layer: int) -> DataFrame:
        inbox = inbox.withColumnRenamed("dst", "vid")
        if not backward:
            if layer == 0:
                return rows.select("vid", F.inline(each_alone))
            kept = _ranked(scored(inbox.join(rows, "vid"), layer), backward).where((F.col("rank") < beam) & (F.col("value") >= CUTOFF * F.col("best")))
            score = F.when(F.col("best") == 0, F.col("value")).otherwise(F.col("value") / F.col("best"))
            return kept.select("vid", "law", "rank", F.concat("nodes", vid).alias("nodes"), F.concat("depths", depth).alias("depths"), score.alias("score"))
        ranked = _ranked(scored(rows.join(inbox, "vid", "left"), layer), backward)
        ranked = ranked.where((F.col("rank") == 0) | ((F.col("best") > 0) & (F.col("rank") < beam) & (F.col("value") >= CUTOFF * F.col("best"))))
        fresh = F.transform(_fresh(F.col("zeros"), beam), lambda x, i: path(F.col("law"), i, F.concat(vid, x["nodes"]), F.concat(depth, x["depths"]), F.lit(0.0)))
        whole = path(F.col("law"), F.col("rank"), F.concat(vid, F.col("nodes")), F.concat(depth, F.col("depths")), F.col("value") / F.col("best"))
        kept = F.when(F.col("nodes").isNull(), each_alone).when(F.col("best") > 0, F.array(whole))
        kept = kept.when((F.col("best") == 0) & (F.size("zeros") > 0), fresh).otherwise(F.array(alone(F.col("law"))))
        return ranked.select("vid", F.inline(kept))

    def send(rows: DataFrame) -> DataFrame:
        return rows.select("dst", F.col("src").alias("via"), "law", "rank", "nodes", "depths", "score", "to")

    return sweep(placed, layered_edges(layers, cond, backward), f"vid long, {_PATH}", f"dst long, via long, {_PATH}", solve, send, backward)


def _ends_with(whole: Column, part: Column) -> Column:
    return (F.size(part) <= F.size(whole)) & (F.slice(whole, F.size(whole) - F.size(part) + 1, F.size(part)) == part)


def _begins_with(whole: Column, part: Column) -> Column:
    return (F.size(part) <= F.size(whole)) & (F.slice(whole, F.lit(1), F.size(part)) == part)


def ways_through(left_out: DataFrame, ahead: DataFrame, back: DataFrame, each: int = EACH) -> DataFrame:
    """(vid, head, tail, nodes, score): the best ways through each vertex of ``left_out(vid)``, up to ``each`` heads by as many tails.

    No chosen path holds such a vertex, so a way can lie inside another way of
    the same vertex only, and there both meet at the vertex: its head ends the
    other's head, and its tail begins the other's tail.  A way that an earlier
    one holds is left out, and so is a vertex alone.  As a head ends itself and
    a tail begins itself, these are the ways whose head ends an earlier head or
    whose tail begins an earlier tail, so heads and tails are judged before
    they are combined.
    """

    def ends(rows: DataFrame, name: str, within: Callable[[Column, Column], Column]) -> DataFrame:
        rows = rows.where(F.col("rank") < each).join(left_out, "vid", "left_semi").groupBy("vid").agg(F.collect_list(F.struct("rank", "nodes", "score")).alias(name))  # ``each`` at most
        return rows.withColumn(name, F.filter(name, lambda x: ~F.exists(name, lambda other: (other["rank"] < x["rank"]) & within(other["nodes"], x["nodes"]))))

    rows = ends(ahead, "heads", _ends_with).join(ends(back, "tails", _begins_with), "vid")
    rows = rows.select("vid", "tails", F.explode("heads").alias("h")).select("vid", "h", F.explode("tails").alias("t"))
    nodes = F.concat("h.nodes", F.slice("t.nodes", F.lit(2), F.size("t.nodes")))
    return rows.select("vid", F.col("h.rank").alias("head"), F.col("t.rank").alias("tail"), nodes.alias("nodes"), (F.col("h.score") + F.col("t.score")).alias("score")).where(F.size("nodes") > 1)


def first_uncovered(order: DataFrame, covers: DataFrame) -> DataFrame:
    """(vid): the vertices of ``order(vid, depth)`` whose turn comes before any way through an earlier chosen one covers them.

    Turns go from the deepest, ties by vid; ``covers(vid, other)`` are the
    vertices on the ways of each.  A vertex that no undecided earlier one covers
    is chosen, and all later ones on its ways are decided with it: the rounds
    give what one turn after the other would.
    """
    spark = order.sparkSession
    turn = lambda name: order.select(F.col("vid").alias(name), F.struct((-F.col("depth")).alias("d"), F.col("vid").alias("v")).alias(f"{name}_turn"))
    later = materialize(covers.select("vid", "other").distinct().join(turn("vid"), "vid").join(turn("other"), "other").where("vid_turn < other_turn").select("vid", "other"))
    if later.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        after: dict[int, list[int]] = {}
        for r in later.collect():  # at most DRIVER_EDGES
            after.setdefault(r["vid"], []).append(r["other"])
        concerned = later.select("vid").unionByName(later.select(F.col("other").alias("vid"))).distinct()
        taken: set[int] = set()
        lost: list[tuple[int]] = []
        for r in concerned.join(order, "vid").orderBy(F.desc("depth"), "vid").collect():
            if r["vid"] in taken:
                lost.append((r["vid"],))
            else:
                taken.update(after.get(r["vid"], []))
        return order.select("vid").join(spark.createDataFrame(lost, "vid long"), "vid", "left_anti")
    lost_ones = Stepwise(spark, "vid long", "round")
    rounds = 0
    while not later.isEmpty():
        heads = later.select("vid").distinct().join(later.select(F.col("other").alias("vid")), "vid", "left_anti")
        covered = materialize(later.join(heads, "vid", "left_semi").select(F.col("other").alias("vid")).distinct())
        lost_ones.add(covered.withColumn("round", F.lit(rounds)))
        gone = heads.unionByName(covered)
        later = materialize(later.join(gone, "vid", "left_anti").join(gone.withColumnRenamed("vid", "other"), "other", "left_anti").select("vid", "other"))
        rounds += 1
    return order.select("vid").join(lost_ones.all().select("vid"), "vid", "left_anti")


def layered_cover(layers: DataFrame, cond: DataFrame, support: DataFrame, bubble: DataFrame | None, beam: int = 15, insert: int = 400, normalized: bool = False, least_score: float = -10.0) -> DataFrame:
    """(path_id, score, nodes): the chosen paths of a graph of any size.

    ``layers(vid, depth, layer)`` has the depth of each vertex's first k-mer and
    its topological layer; ``support(v1, v2, cnt)`` and ``bubble(v1, v2)`` hold a
    pair once; without ``bubble`` support is weighed already.  A path is called by its vertex, head and tail: the source and 0
    for its own sub-paths, else the vertex that was left out.  No vertices give
    no rows; without support all gains are those of pairs without it.
    """
    support = materialize(weighed(_marked(support, bubble), (normalized,))) if bubble is not None else support
    back, ahead = (sub_paths_by_laws(layers, cond, support, beam, insert, (normalized,), backward) for backward in (True, False))
    sources = layers.where("layer = 0").select("vid")
    first = back.join(sources, "vid", "left_semi").select("vid", F.lit(0).alias("head"), F.col("rank").alias("tail"), "nodes", "score")
    used = first.select(F.explode("nodes").alias("vid")).distinct()
    left_out = materialize(layers.select("vid", "depth").join(used, "vid", "left_anti"))
    through = materialize(ways_through(left_out.select("vid"), ahead, back))
    covers = through.select("vid", F.explode("nodes").alias("other")).join(left_out.select(F.col("vid").alias("other")), "other", "left_semi")
    taken = through.join(first_uncovered(left_out, covers), "vid", "left_semi")
    named = F.concat_ws(".", F.col("vid").cast("string"), F.col("head").cast("string"), F.col("tail").cast("string"))
    return first.unionByName(taken.select(*first.columns)).where(F.col("score") >= least_score).select(named.alias("path_id"), "score", "nodes")
