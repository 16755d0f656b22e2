"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Identical vectors are one class
with a weight; classes are hashed. A table's bucket is the signs of `bits` projections. Within a bucket all cosines are
computed in double precision, block against block, so a large bucket is work for many tasks and never one group; what
leaves a task is each class's number of links and a spanning forest of them, not the pairs. A pair that shares several
tables counts in the first. Bits follow the logarithm of the number of classes, and tables are as many as it takes to
find a pair at the threshold with probability RECALL; closer pairs are found more surely still.

Rows that share a vec_id are vectors of their own, and count each other as links where they are near; a null vec_id is kept like any other.
Vectors of different dimensions are not compared. An empty table gives an empty result; other columns are left out, whatever their
names. A task holds two blocks of vectors and their cosines. Building the result runs many jobs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.components import components
from shiftlens.llm.stored import Steps, stored

COSINE = 0.95
RECALL = 0.999
#: Classes in a block: two blocks of these and their cosines are what a task holds.
BLOCK = 1024
_SEED = 20240229


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables needed to find a pair at `cosine` with probability `recall`."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the pairs that join what earlier pairs have not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append(k)
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding)."""
    e = F.col("embedding")
    fit = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fit, e).alias("embedding"))
    rows = rows.withColumns({"h0": F.when(fit, F.xxhash64("embedding")), "h1": F.when(fit, F.xxhash64(F.lit(1), "embedding"))})
    with Steps(vectors.sparkSession) as step:
        made = rows.where("embedding is not null").groupBy("h0", "h1").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
        classes = step.stored(made.withColumn("node", F.monotonically_increasing_id()))  # numbered as they are written, so no two share a number
        bits = max(8, math.ceil(math.log2(max(2, classes.count()))) - 3)
        n_tables = tables_for(bits, cosine, recall)

        def sign(batches):
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                sizes = batch.column("embedding").value_lengths().to_numpy()
                for d in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == d))
                    if d not in planes:
                        planes[d] = np.random.default_rng([_SEED, int(d)]).standard_normal((int(d), n_tables * bits))
                    positive = (_unit(_matrix(part.column("embedding"))) @ planes[d] >= 0).reshape(part.num_rows, n_tables, bits)
                    names = positive.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (part.num_rows + 1) * n_tables, n_tables, dtype=np.int32)), pa.array(names.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("node", "weight", "embedding")] + [lists], ["node", "weight", "embedding", "names"])

        kind = dict(rows.dtypes)["embedding"]
        signed = step.stored(classes.select("node", "weight", "embedding").mapInArrow(sign, f"node long, weight long, embedding {kind}, names array<long>"))
        members = signed.select("node", F.size("embedding").alias("d"), F.posexplode("names").alias("t", "name"))
        sizes = step.stored(members.groupBy("d", "t", "name").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1"))
        # A class goes to a block of its bucket by hash, and to a task for each pair of blocks that its own is in.
        placed = signed.select("node", "weight", "embedding", "names", F.size("embedding").alias("d"), F.posexplode("names").alias("t", "name")).join(sizes, ["d", "t", "name"])
        placed = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), "blocks"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        placed = placed.withColumn("task", F.xxhash64("d", "t", "name", F.least("own", "other"), F.greatest("own", "other")))

        def link(batches):
            # Tasks are contiguous; tasks of few rows are many, so rows are gathered into batches of whole tasks.
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= 4 * block:
                    table = pa.Table.from_batches(held)
                    keys = table.column("task").to_numpy()
                    whole = int(np.searchsorted(keys, keys[-1]))
                    if whole:
                        yield from compare(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    n = table.num_rows - whole
            if held:
                yield from compare(pa.Table.from_batches(held))

        def compare(table):
            table = table.combine_chunks()
            node, weight, own, other, t, task = (table.column(c).to_numpy() for c in ("node", "weight", "own", "other", "t", "task"))
            names = table.column("names").chunk(0).flatten().to_numpy().reshape(len(node), -1)
            column = table.column("embedding").chunk(0)
            cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                x = _unit(_matrix(column.slice(a, b - a)))
                i, j = np.nonzero(x @ x.T >= cosine)
                i, j = i[i < j] + a, j[i < j] + a
                # Two blocks meet here; pairs within a block belong to the task of that block alone.
                apart = (own[i] != own[j]) | (other[i] == own[i])
                i, j = i[apart], j[apart]
                once = np.ones(len(i), bool)
                for k in range(0, len(i), 1 << 16):  # a bounded number of pairs at a time
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    once[k : k + (1 << 16)] = ~((names[p] == names[q]) & (np.arange(n_tables) < t[p][:, None])).any(axis=1)
                i, j = i[once], j[once]
                if len(i):
                    count = np.bincount(i - a, weight[j], b - a) + np.bincount(j - a, weight[i], b - a)
                    some, tree = np.flatnonzero(count), _forest(i, j)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([node[a + some], node[i[tree]]])), pa.array(np.concatenate([np.zeros(len(some), np.int64), node[j[tree]]])), pa.array(np.concatenate([count[some], np.zeros(len(tree))]).astype(np.int64))],
                        ["a", "b", "n"],
                    )

        dealt = placed.select("task", "t", "own", "other", "node", "weight", "names", "embedding").repartition("task").sortWithinPartitions("task")
        found = step.stored(dealt.mapInArrow(link, "a long, b long, n long"))
        degree = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
        reached = components(found.where("n = 0").select("a", "b"))
        of = classes.select("h0", "h1", "node", "least", "weight").join(degree, "node", "left").join(reached, "node", "left")
        least = step.stored(of.where("component is not null").groupBy("component").agg(F.min("least").alias("component_least")))
        of = stored(of.join(least, "component", "left").select("h0", "h1", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"), F.coalesce("component_least", "least").alias("component_id")))
    out = rows.drop("embedding").join(of, ["h0", "h1"], "left").select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
