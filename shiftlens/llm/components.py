"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, stored

_MOST_ROUNDS = 60
#: From so many links on a round's minima are stored before links are joined to them, so that a centre's links can be split in the join.
_MANY = 5_000_000


def _written(step: Steps, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored links, and their number and a sum of their hashes, observed while they are written."""
    seen = Observation()
    now = step.stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")))
    return now, (seen.get["n"], seen.get["hashes"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least node that links reach.

    Each round hangs every node's larger neighbours on the least one (large star), then its smaller neighbours and itself
    (small star), and is written to the shared folder; rounds grow with the logarithm of the longest chain. Minima are
    aggregated before they are dealt, and no neighbourhood is gathered in one place. Isolated nodes don't appear. Nodes may have any
    type with an order."""
    with Steps(edges.sparkSession) as step:
        now, state = _written(step, edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct())
        for _ in range(_MOST_ROUNDS):
            if not state[0]:
                break
            table = step.stored if state[0] >= _MANY else lambda df: df
            both = now.unionByName(now.selectExpr("v as u", "u as v"))
            least = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
            least = table(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v"))
            before = state
            now, state = _written(step, small.distinct())
            if before == state:
                break
        else:
            raise RuntimeError(f"components did not settle in {_MOST_ROUNDS} rounds")
        return stored(now.selectExpr("u as node", "v as component").unionByName(now.selectExpr("v as node", "v as component").distinct()))
