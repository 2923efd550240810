"""Acyclic graphs layer by layer: topological layers, path counts and depth-first depths.

A vertex lies one layer behind the last of its predecessors.  What a layer has
found is sent along its edges as messages to the layers that need it, and a
layer reads its own messages only, so a sweep over all layers moves every edge
once, however many layers there are.  No vertex, component or layer
is gathered anywhere; rows are grouped by vertex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidmill.session import Stepwise, bookmark, forget, held, materialize

#: Edges that the driver peels itself; graphs with more are peeled by joins.
DRIVER_EDGES = 200_000


def _cycle(n: int) -> ValueError:
    return ValueError(f"the graph has a cycle: {n} vertices lie on one or behind one")


def _peeled_by_driver(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Layers of the vertices that have edges, walked here; the others are in layer 0."""
    missing: dict[int, int] = {}
    after: dict[int, list[int]] = {}
    for r in edges.collect():  # at most DRIVER_EDGES
        missing.setdefault(r["src"], 0)
        missing[r["dst"]] = missing.get(r["dst"], 0) + 1
        after.setdefault(r["src"], []).append(r["dst"])
    front, rows, layer = [v for v, n in missing.items() if n == 0], [], 0
    while front:
        rows += [(v, layer) for v in front]
        reached, front = front, []
        for v in reached:
            for w in after.get(v, []):
                missing[w] -= 1
                if missing[w] == 0:
                    front.append(w)
        layer += 1
    if len(rows) < len(missing):
        raise _cycle(len(missing) - len(rows))
    walked = vertices.sparkSession.createDataFrame(rows, "vid long, layer int")
    return vertices.select("vid").join(walked, "vid", "left").select("vid", F.coalesce("layer", F.lit(0)).alias("layer"))


def _peeled_by_joins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A round takes the vertices that miss no predecessor; it writes how many the others still miss. Edges lie where their ``src`` does and are not moved."""
    spark = vertices.sparkSession
    edges = held(edges, edges.count(), "src")
    missing = vertices.select("vid", F.lit(0).cast("long").alias("n")).unionByName(edges.select(F.col("dst").alias("vid"), F.lit(1).cast("long").alias("n")))
    done = Stepwise(spark, "vid long")
    left, layer = vertices.select("vid").distinct().count(), 0
    while True:
        since = bookmark()
        state = materialize(missing.groupBy("vid").agg(F.sum("n").alias("n")))
        forget(since - 1 if layer else since, keep=1)  # the state before it
        front = state.where("n = 0").select("vid")
        n = front.count()
        if not n:
            break
        done.put(front, layer)
        left, layer = left - n, layer + 1
        hits = edges.join(front.withColumnRenamed("vid", "src"), "src").select(F.col("dst").alias("vid"), F.lit(-1).cast("long").alias("n"))
        missing = state.where("n > 0").unionByName(hits)
    edges.unpersist()
    if left:
        raise _cycle(left)
    return done.all()


def topological_layers(vertices: DataFrame, cond: DataFrame) -> DataFrame:
    """(vid, layer) of every vertex: 0 without predecessors, else one more than the last of them.

    ``vertices`` has ``vid``; repeated edges count once, and edges must join
    vertices of the table.  A cycle is an error that tells how many vertices
    it keeps from a layer.  No vertices give no rows.
    """
    edges = materialize(cond.select("src", "dst").distinct())
    few = edges.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES
    return materialize((_peeled_by_driver if few else _peeled_by_joins)(vertices, edges))


def located(layers: DataFrame, cond: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, src_layer, dst_layer); ``cond`` is returned if it is such a table."""
    if {"src_layer", "dst_layer"} <= set(cond.columns):
        return cond
    side = lambda end: layers.select(F.col("vid").alias(end), F.col("layer").alias(f"{end}_layer"))
    return cond.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_layer", "dst_layer")


def layered_edges(layers: DataFrame, cond: DataFrame, backward: bool = False) -> Stepwise:
    """Edges (src, dst, to) in folders of the layer they leave; ``to`` is the layer they reach.

    Backward they leave from ``dst``, which is then called ``src``.
    """
    start, end = ("dst", "src") if backward else ("src", "dst")
    rows = located(layers, cond).select(F.col(start).alias("src"), F.col(end).alias("dst"), F.col(f"{end}_layer").alias("to"), F.col(f"{start}_layer").alias("layer"))
    out = Stepwise(layers.sparkSession, "src long, dst long, to int")
    out.add(rows)
    return out


Solve = Callable[[DataFrame, DataFrame, int], DataFrame]


def by_layer(layers: DataFrame) -> Stepwise:
    """The rows of ``layers`` in folders of their layer."""
    out = Stepwise(layers.sparkSession, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in layers.schema.fields if f.name != "layer"))
    out.add(layers)
    return out


def sweep(placed: Stepwise, edges: Stepwise, states: str, messages: str, solve: Solve, send: Callable[[DataFrame], DataFrame], backward: bool = False) -> DataFrame:
    """What ``solve`` finds for every vertex, from the layers before it (or, backward, behind it).

    ``solve(vertices, inbox, layer)`` makes rows of schema ``states`` (with
    ``vid``) from one layer's rows of ``placed`` and the messages to it;
    ``send(rows)`` makes messages of schema ``messages`` from these rows joined
    with their edges (``dst`` is the vertex a message goes to).  Messages to the
    next layer are made where it is solved; only those that go further are written.
    """
    spark = placed.spark
    found, sent = Stepwise(spark, states), Stepwise(spark, messages)
    names = [name for name in sent.schema.names if name != sent.at]
    last, since = placed.all().agg(F.max("layer")).first()[0], bookmark()
    numbers, on = range(0 if last is None else last + 1), -1 if backward else 1
    further = {r["layer"] for r in edges.all().where(F.col("to") != F.col("layer") + on).select("layer").distinct().collect()}  # a row a layer

    def leaving(layer: int, near: bool) -> DataFrame:
        rows = edges.step(layer).where(F.col("to") == layer + on if near else F.col("to") != layer + on)
        return send(rows.join(found.step(layer).withColumnRenamed("vid", "src"), "src"))

    for layer in reversed(numbers) if backward else numbers:
        inbox = sent.step(layer)
        if layer - on in numbers:
            near = leaving(layer - on, True).select(*names)
            inbox = near.unionByName(inbox) if sent.has(layer) else near
        found.put(solve(placed.step(layer), inbox, layer), layer)
        sent.drop(layer)
        forget(since, keep=0)  # what ``solve`` has written
        if layer in further:
            sent.add(leaving(layer, False).withColumnRenamed("to", "layer"))
    return found.all()


def ways(layers: DataFrame, cond: DataFrame) -> DataFrame:
    """(vid, layer, n decimal(38,0)): ways from any source to each vertex; beyond 38 digits it is an error."""

    def solve(own: DataFrame, inbox: DataFrame, layer: int) -> DataFrame:
        more = inbox.groupBy(F.col("dst").alias("vid")).agg(F.sum("n").alias("n"))
        return own.join(more, "vid", "left").select("vid", F.coalesce("n", F.lit(1)).cast("decimal(38,0)").alias("n"))

    send = lambda rows: rows.select("dst", "n", "to")
    return sweep(by_layer(layers), layered_edges(layers, cond), "vid long, n decimal(38,0)", "dst long, n decimal(38,0)", solve, send)


def path_totals(layers: DataFrame, cond: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, n_paths decimal(38,0)): ways from sources to sinks, by the component that ``labels(vid, component)`` gives."""
    last = ways(layers, cond).join(cond.select(F.col("src").alias("vid")).distinct(), "vid", "left_anti")
    return last.join(labels, "vid").groupBy("component").agg(F.sum("n").cast("decimal(38,0)").alias("n_paths"))


def depth_first(layers: DataFrame, vertices: DataFrame, cond: DataFrame, k: int, start: DataFrame | None = None) -> DataFrame:
    """(vid, depth, root, layer): depths of each vertex's first k-mer on the tree of a depth-first walk.

    ``vertices`` has vid, len, cnt and kmer: sources and children are visited
    by count from the highest, ties by k-mer; sources of ``start(vid, ord)``
    come first.  On an acyclic graph the walk reaches a vertex by the smallest
    of its paths, compared source first and then child by child.  Only where a
    vertex has several children do two paths to one vertex part, so a path is
    kept as its root and the numbers of the children chosen at such vertices.
    """
    order = Window.partitionBy("src").orderBy(F.desc("cnt"), "kmer")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = vertices.select(F.col("vid").alias("dst"), "cnt", "kmer")
    rows = located(layers, cond)
    most = rows.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    digits = len(f"{most or 1:x}")
    ranked = rows.join(heads, "dst").withColumn("place", F.row_number().over(order) - 1).withColumn("children", F.count("*").over(whole))
    choice = F.when(F.col("children") == 1, F.lit("")).otherwise(F.lpad(F.lower(F.hex("place")), digits, "0"))
    tails = vertices.select(F.col("vid").alias("src"), (F.col("len") - k + 1).cast("long").alias("step"))
    edges = Stepwise(layers.sparkSession, "src long, dst long, choice string, step long, to int")
    edges.add(ranked.join(tails, "src").select("src", "dst", choice.alias("choice"), "step", F.col("dst_layer").alias("to"), F.col("src_layer").alias("layer")))
    begin = vertices.select("vid", "cnt", "kmer") if start is None else vertices.select("vid", "cnt", "kmer").join(start, "vid", "left")
    given = F.lit(None).cast("long") if start is None else F.col("ord").cast("long")
    begin = begin.select("vid", F.struct(given.isNull().alias("later"), given.alias("ord"), (-F.col("cnt")).cast("double").alias("cnt"), F.col("kmer").alias("kmer")).alias("first"))
    begin = materialize(begin.join(layers.where("layer = 0").select("vid"), "vid", "left_semi"))
    root = "first struct<later: boolean, ord: bigint, cnt: double, kmer: string>, path string, depth long, root long"
    pick = ["first", "path", "depth", "root"]

    def solve(own: DataFrame, inbox: DataFrame, layer: int) -> DataFrame:
        if layer == 0:
            return own.join(begin, "vid").select("vid", "first", F.lit("").alias("path"), F.lit(0).cast("long").alias("depth"), F.col("vid").alias("root"))
        best = inbox.groupBy(F.col("dst").alias("vid")).agg(F.min(F.struct(*pick)).alias("best"))
        return best.select("vid", *[F.col(f"best.{c}").alias(c) for c in pick])

    def send(rows: DataFrame) -> DataFrame:
        return rows.select("dst", "first", F.concat("path", "choice").alias("path"), (F.col("depth") + F.col("step")).alias("depth"), "root", "to")

    return sweep(by_layer(layers.select("vid", "layer")), edges, f"vid long, {root}", f"dst long, {root}", solve, send).select("vid", F.col("depth").cast("int").alias("depth"), "root", "layer")
