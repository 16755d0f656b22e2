"""Strongly connected components by rounds of joins: chains are drawn together, what hangs at the end is trimmed, then forward and backward colouring.

Joins sort and merge: a round's table is often small enough to be sent to all tasks, and the rounds' copies would add up on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.sources.shared import Steps, stored


#: How many hops a round takes before it is stored.
_HOPS = 3


def _trimmed(step: Steps, edges: DataFrame) -> DataFrame:
    """edges(src, dst) without those that no cycle holds because they hang at its end: again and again edges go whose source none enters or whose target none
    leaves, until none goes."""
    n = edges.count()
    while n:
        for _ in range(_HOPS):
            entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
            edges = edges.join(entered.hint("merge"), "src", "left_semi").join(left.hint("merge"), "dst", "left_semi")
        edges = step.stored(edges)
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _coloured(step: Steps, edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node from which each one is reached, itself included."""
    colour = step.stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        now = colour.withColumn("was", F.col("colour"))
        for _ in range(_HOPS):
            met = edges.join(now.select(F.col("node").alias("src"), "colour").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("met"))
            now = now.join(met.hint("merge"), "node", "left").select("node", F.greatest("colour", F.coalesce("met", "colour")).alias("colour"), "was")
        now = step.stored(now)
        if now.where("colour > was").isEmpty():
            return now.drop("was")
        colour = now.drop("was")


def _reaching(step: Steps, edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, colour) of the nodes from which the node that names their colour is reached along edges(src, dst)."""
    state = colour.withColumn("there", F.col("node") == F.col("colour"))
    while True:
        now = state.withColumn("was", F.col("there"))
        for _ in range(_HOPS):
            back = edges.join(now.where("there").select(F.col("node").alias("dst")).hint("merge"), "dst").select(F.col("src").alias("node")).distinct().withColumn("met", F.lit(True))
            now = now.join(back.hint("merge"), "node", "left").select("node", "colour", (F.col("there") | F.coalesce("met", F.lit(False))).alias("there"), "was")
        now = step.stored(now)
        state = now.drop("was")
        if now.where("there and not was").isEmpty():
            return state.where("there").drop("there")


def _drawn_together(step: Steps, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges(src, dst) with an edge in place of each chain of nodes that one edge enters and one leaves; (node, last) of the chains' nodes with the chain's
    (src, dst) beside them; and (node, colour) of rings, which are such nodes alone. Steps double from round to round."""
    degrees = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("in"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("in"), F.lit(None).cast(edges.schema["dst"].dataType).alias("to")))).alias("x")).select("x.*")
    links = degrees.groupBy("node").agg(F.sum("in").alias("in"), F.sum(1 - F.col("in")).alias("out"), F.max("to").alias("to")).where("in = 1 and out = 1")
    links = step.stored(links.select("node", "to"))
    names = links.select(F.col("node").alias("to"), F.lit(True).alias("on"))
    # last: how far a node has come; ended: whether that is its chain's last node; most: the greatest node on the way.
    state = step.stored(links.join(names.hint("merge"), "to", "left").select("node", F.when(F.col("on"), F.col("to")).otherwise(F.col("node")).alias("last"), F.col("on").isNull().alias("ended"), F.col("node").alias("most")))
    while True:
        ahead = state.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("ended").alias("_ended"), F.col("most").alias("_most"))
        moving = state.where("not ended").join(ahead.hint("merge"), "last").select("node", F.col("_last").alias("last"), F.col("_ended").alias("ended"), F.greatest("most", "_most").alias("most"), (F.col("_ended") | (F.col("_most") > F.col("most"))).alias("new"))
        now = step.stored(state.where("ended").withColumn("new", F.lit(False)).unionByName(moving))
        state = now.drop("new")
        if now.where("new").isEmpty():  # only rings are left, and their greatest node has come round
            break
    rings = state.where("not ended").select("node", F.col("most").alias("colour"))
    chained = step.stored(state.where("ended").select("node", "last"))
    on = chained.select(F.col("node").alias("dst"), "last")
    entered = edges.join(names.select(F.col("to").alias("src")).hint("merge"), "src", "left_anti").join(on.hint("merge"), "dst").select("src", "last")
    left = chained.where("node = last").join(links.hint("merge"), "node").select("last", F.col("to").alias("dst"))
    chains = step.stored(entered.join(left.hint("merge"), "last").select("last", "src", "dst"))
    nodes = names.select(F.col("to").alias("node")).hint("merge")
    direct = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
    kept = direct.select("src", "dst").unionByName(chains.where("src <> dst").select("src", "dst")).distinct()
    return step.stored(kept), step.stored(chained.join(chains.hint("merge"), "last").select("node", "src", "dst")), step.stored(rings)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that share a cycle of two or more nodes with others; a component is named by its greatest node.

    Chains of nodes with one edge in and one out are drawn together first, by doubling, so that a ring or a long way takes few rounds; their nodes belong to the
    component of both their ends, if that is one. A node's colour is the greatest node that reaches it. Of a colour those nodes from which that one is reached in
    turn, along edges within the colour, are its component. They go, and what is left is drawn together, trimmed and coloured anew. Every round is stored."""
    with Steps(edges.sparkSession) as step:
        left = step.stored(edges.where("src <> dst").select("src", "dst").distinct())
        found = left.select(F.col("src").alias("node"), F.col("src").alias("colour")).limit(0)
        drawn = []
        while True:
            left, chains, rings = _drawn_together(step, left)
            drawn.append(chains)
            found = found.unionByName(rings)
            left = _trimmed(step, left)
            if left.isEmpty():
                break
            colour = _coloured(step, left)
            inside = left.join(colour.toDF("src", "colour").hint("merge"), "src").join(colour.toDF("dst", "other").hint("merge"), "dst").where("colour = other").select("src", "dst")
            inside = step.stored(inside)
            reached = _reaching(step, inside, colour)
            found = found.unionByName(reached)
            gone = reached.select("node")
            left = step.stored(left.join(gone.toDF("src").hint("merge"), "src", "left_anti").join(gone.toDF("dst").hint("merge"), "dst", "left_anti"))
        found = step.stored(found)
        for chains in reversed(drawn):  # a node without a row is a component of its own
            if chains.isEmpty():
                continue
            own = lambda end: found.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")).hint("merge")
            ends = chains.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
            ends = ends.select("node", "src", F.coalesce("src_colour", "src").alias("colour"), F.coalesce("dst_colour", "dst").alias("other"), F.col("src_colour").isNull().alias("alone")).where("colour = other")
            found = step.stored(found.unionByName(ends.select("node", "colour")).unionByName(ends.where("alone").select(F.col("src").alias("node"), "colour").distinct()))
        several = found.groupBy("colour").agg(F.count("*").alias("n"), F.max("node").alias("component")).where("n > 1").select("colour", "component")
        return stored(found.join(several.hint("merge"), "colour").select("node", "component"))
