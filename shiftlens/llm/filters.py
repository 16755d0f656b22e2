"""Filter interaction audit: what each of several document filters removes, alone, after the others, and on average over all orders.

Every document fails a set of filters. Counts by that set, at most 2**n a part, are all that is gathered. From them every
coalition of filters gets what it would remove, with the good and the toxic documents among that; a step of an order removes the difference of
two coalitions. Shapley values come from the exact constrained least squares: of all additive values that give the full coalition its removals
they are nearest to what the coalitions remove, weighted by the Shapley kernel. The normal equations are solved in rationals, once, for
every coalition at a time; the solution is then a whole number of removals summed over all orders.

A null text is empty, a null part ''. A text is a repeat if an equal text has a smaller doc_id anywhere in the table; a null doc_id is larger than any
other, and such rows don't make each other repeats, nor do rows that share a doc_id. Labels belong to all rows of a doc_id;
where it has several a 1 counts. An empty table gives no rows; other columns are left out, whatever their names.

Nothing is gathered by text: repeats are found by the least doc_id of each text's digest, combined in the map tasks, and joined back by digest and doc_id,
so a text that fills the table is one row a task. A task holds one text's words.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, stored

FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A to D: few words, few different ones, many capitals, signs. E is a matter of the whole table."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters they fail; bit k of `failed` is filter k. Runs a job when called."""
    text = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.shiftleft(c.cast("int"), k) for k, c in enumerate(conditions(F.col("text"), F.col("words")))]
    rows = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("own"))
    with Steps(docs.sparkSession) as step:
        # Rows without a doc_id are dealt by their digest, as they have neither labels nor a partner.
        key = F.coalesce("doc_id", F.xxhash64("digest"))
        rows = step.stored(rows.groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n")).withColumns({"key": key, "none": F.col("doc_id").isNull()}))
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", key.alias("key"), F.col("doc_id").isNull().alias("none"), F.lit(True).alias("is_first"))
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
        known = known.select(F.col("doc_id").alias("key"), F.lit(False).alias("none"), "is_good", "is_toxic")
        judged = rows.join(first, ["digest", "key", "none"], "left").join(known, ["key", "none"], "left")
        failed = F.col("own") + F.when(F.col("is_first"), 0).otherwise(1 << len(bits))
        of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
        cells = judged.groupBy("part", failed.alias("failed")).agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))
        return stored(cells)


def coalitions(cells: DataFrame, n: int) -> DataFrame:
    """(part, total, removed): what every coalition of n filters removes, an array of (coalition, n, good, toxic) by coalition, 2**n long."""
    each = cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("coalition").bitwiseAND(F.col("failed")) != 0
    sums = each.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")))
    return sums.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("removed"))


def shapley_sums(n: int) -> list[list[int]]:
    """For each of n filters a factor for each coalition: the sum of factor * value is what the filter adds, summed over all n! orders.

    Least squares over the proper coalitions, weighted by (n - 1) / (comb(n, s) * s * (n - s)), under the condition that the values add up to that of
    the full coalition: normal equations with one multiplier, solved in rationals for all coalitions as right sides."""
    full = (1 << n) - 1
    rows = [[Fraction(0)] * (n + 1 + full + 1) for _ in range(n + 1)]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        held = [k for k in range(n) if s >> k & 1]
        for i in held:
            for j in held:
                rows[i][j] += weight
            rows[i][n + 1 + s] += weight
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1 + full] = Fraction(1)
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    scaled = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def steps(removed: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row a part, order of all filters and step, from coalitions()."""
    n = len(names)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    each = removed.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = f"transform(split(left(filter_order, {n}), ''), c -> shiftleft(1, instr('{names}', c) - 1))"
    each = each.withColumns({"bits": F.expr(bit), "letter": F.expr(f"instr('{names}', substring(filter_order, step, 1))")})
    each = each.withColumns({"was": F.expr("aggregate(slice(bits, 1, step - 1), 0, (a, b) -> a | b)"), "own": F.expr("bits[step - 1]")}).withColumn("now", F.col("was").bitwiseOR(F.col("own")))
    at = lambda coalition, c: F.get("removed", coalition)[c]
    here = lambda c: at(F.col("now"), c) - at(F.col("was"), c)
    full = F.lit((1 << n) - 1)
    factors = F.array(*(F.array(*(F.lit(x).cast("long") for x in row)) for row in shapley_sums(n)))
    added = F.aggregate(F.zip_with("removed", F.get(factors, F.col("letter") - 1), lambda r, w: r["n"] * w), F.lit(0).cast("long"), lambda a, b: a + b)
    columns = {
        "kept": F.col("total") - at(F.col("now"), "n"), "removed": here("n"), "redundant": at(F.col("own"), "n") - here("n"), "unique_fails": at(full, "n") - at(full.bitwiseXOR(F.col("own")), "n"),
        "good_lost": here("good"), "toxic_lost": here("toxic"), "shapley": added,
    }
    return each.select("part", "filter_order", "step", *(c.cast("long").alias(name) for name, c in columns.items()))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the five filters."""
    return steps(coalitions(failures(docs, labels, part), len(FILTERS)))
