"""Mixing sources to target weights, with DataFrame functions only.

A classifier learned from a table of labelled documents gives every document a posterior over the domains (soft
membership). Projected-gradient least squares then fits a nonnegative rate for each document, how often it is to be
drawn, so that the expected tokens of each domain, sum of rate * tokens * posterior, make up its target share of the corpus.
Starting from a rate of one everywhere, each step is one aggregation of two numbers a domain; only these reach the driver.

The classifier is multinomial logistic regression on signs of style and on evidence from a lexicon of the words that best
tell the domains apart in a bounded sample. Null and empty texts have no tokens; they get the posterior of an empty
text and a rate that changes no total. Documents labelled more than once count under each label. A target domain
without labelled rows gets no posterior, so its target can't be met and the others come as near as least squares allows;
with no labelled rows at all posteriors are uniform. Targets that are not met when the steps end are told by a warning. Every row gives one row, also where
rows repeat or share a doc_id; an empty table gives an empty result. Other columns are carried along, but for those called like an added one, which
are replaced. A task holds one whole text and its words. Fitting runs jobs when called.
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.sampling import likely_sampled, sample_order
from shiftlens.llm.stored import Steps, stored

#: Shares of the corpus's tokens that the mixed corpus is to give to each domain.
TARGETS = {"good": 0.94, "low": 0.04, "toxic": 0.02}

_STYLE = ["ln(1 + n_tokens)", "regexp_count(text, '[!#$%&*|]+') / n", "regexp_count(text, '[A-Z]{3,}') / n", "regexp_count(text, '[0-9]+') / n", "regexp_count(text, '\n') / n"]
_SMOOTH = 0.5


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("text", text).withColumn("n_tokens", F.when(F.trim("text") == "", F.lit(0)).otherwise(F.size(F.split(F.trim("text"), r"\s+"))).cast("long"))
    docs = docs.withColumn("n", F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")).withColumn("words", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    return docs.withColumn("style", F.array(*(F.expr(s).cast("double") for s in _STYLE)))


def lexicon(sample: DataFrame, domains: list[str], per_domain: int) -> dict[str, list[float]]:
    """Evidence of a word for each domain: the per_domain words of greatest chi-squared for each. Bounded by the parameters."""
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    words = sample.select("domain", F.explode("words").alias("word")).where("word <> ''")
    table = words.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)), F.count("*").alias("c")).where("c >= 5")
    best = {}
    for k, d in enumerate(domains):
        n = sizes.get(d, 0)
        if not 0 < n < total:
            continue
        p = F.col("c") / total
        chi = (F.col(f"c{k}") / n - (F.col("c") - F.col(f"c{k}")) / (total - n)) ** 2 / (p * (1 - p) * (1 / n + 1 / (total - n)) + 1e-12)
        for row in table.withColumn("chi", chi).where("chi > 15").orderBy(F.desc("chi"), "word").limit(per_domain).collect():
            best[row["word"]] = [math.log((row[f"c{j}"] + _SMOOTH) / (sizes.get(e, 0) + 1)) - math.log((row["c"] + _SMOOTH) / (total + 1)) for j, e in enumerate(domains)]
    return best


def _features(base: DataFrame, evidence: dict[str, list[float]], k: int) -> DataFrame:
    if not evidence:
        return base.withColumn("x", F.concat("style", F.array_repeat(F.lit(0.0), k)))
    known, table = F.array(*map(F.lit, evidence)), F.from_json(F.lit(json.dumps(evidence)), "map<string,array<double>>")
    zero = F.array_repeat(F.lit(0.0), k)
    told = F.aggregate(F.transform(F.array_intersect("words", known), lambda w: F.element_at(table, w)), zero, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
    return base.withColumn("x", F.concat("style", F.transform(told, lambda v: F.tanh(v / 4) * 4)))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    odds = [F.exp(s - top) for s in scores]
    whole = odds[0]
    for o in odds[1:]:
        whole = whole + o
    return [o / whole for o in odds]


def _dot(values: Column | str, weights: list[float]) -> Column:
    """values . weights. The weights stand in one array, so that new ones need no newly compiled code."""
    return F.aggregate(F.zip_with(values, F.lit(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _scaled(x: str, mean: list[float], scale: list[float]) -> Column:
    """Standardised features and a constant."""
    centred = F.zip_with(F.zip_with(x, F.lit(mean), lambda a, b: a - b), F.lit(scale), lambda a, b: a / b)
    return F.concat(centred, F.array(F.lit(1.0)))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 6000, per_domain: int = 64, rounds: int = 40, decay: float = 1e-4) -> DataFrame:
    """docs(doc_id, text, ...) with n_tokens and p, its posterior over `domains`, fitted on at most sample_rows rows of labelled(doc_id, domain)."""
    k, base = len(domains), _base(docs)
    known = labelled.where(F.col("domain").isin(domains))
    chosen = known.where(likely_sampled(11, sample_rows, known.count(), "doc_id")).orderBy(sample_order(11, "doc_id"), "doc_id", "domain").limit(sample_rows)
    with Steps(docs.sparkSession) as step:
        sample = step.stored(_base(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("domain", "words", "style"))
        if not sample.limit(1).count():
            return base.withColumn("p", F.array_repeat(F.lit(1.0 / k), k)).drop("n", "words", "style")
        evidence = lexicon(sample, domains, per_domain)
        rows = step.stored(_features(sample, evidence, k).select("domain", "x"))
        d = len(_STYLE) + k
        stats = rows.agg(F.count("*").alias("n"), *(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d))).first()
        mean, scale = [stats[f"m{i}"] for i in range(d)], [stats[f"s{i}"] or 1.0 for i in range(d)]
        rows = step.stored(rows.select(_scaled("x", mean, scale).alias("z"), *((F.col("domain") == name).cast("double").alias(f"is{c}") for c, name in enumerate(domains))))
        weights, speed = [[0.0] * (d + 1) for _ in domains], [[0.0] * (d + 1) for _ in domains]
        rate = 2.0 / (d + 1)
        for _ in range(rounds):
            ahead = [[w + 0.9 * v for w, v in zip(a, b, strict=True)] for a, b in zip(weights, speed, strict=True)]
            # The gradient's parts come from one projection of the scores and one aggregation of k * (d + 1) sums.
            scored = rows.select("*", *(_dot("z", w).alias(f"s{c}") for c, w in enumerate(ahead)))
            off = scored.select("z", *((q - F.col(f"is{c}")).alias(f"o{c}") for c, q in enumerate(_softmax([F.col(f"s{c}") for c in range(k)]))))
            g = off.agg(*(F.avg(F.col(f"o{c}") * F.get("z", F.lit(i))).alias(f"g{c}_{i}") for c in range(k) for i in range(d + 1))).first()
            for c in range(k):
                for i in range(d + 1):
                    speed[c][i] = 0.9 * speed[c][i] - rate * (g[f"g{c}_{i}"] + decay * ahead[c][i])
                    weights[c][i] += speed[c][i]
    scored = _features(base, evidence, k).withColumn("z", _scaled("x", mean, scale)).withColumns({f"s{c}": _dot("z", w) for c, w in enumerate(weights)})
    return scored.withColumn("p", F.array(*_softmax([F.col(f"s{c}") for c in range(k)]))).drop("n", "words", "style", "x", "z", *(f"s{c}" for c in range(k)))


def fit_steps(soft: DataFrame, targets: list[float], tolerance: float = 5e-4, most: int = 60, every: int = 5) -> list[tuple[list[float], float]]:
    """The steps (slope over the domains, momentum) that lead every document of soft(n_tokens, p) from a rate of one to its
    fitted rate. Steps are accelerated by momentum; every few of them the rates are written out, so that plans stay short. Ends
    when every domain's share is within `tolerance` of its target, or after `most` steps."""
    k, whole = len(targets), sum(targets)
    goal = [t / whole for t in targets]
    now = soft.select("n_tokens", "p").where("n_tokens > 0").withColumns({"r": F.lit(1.0), "y": F.lit(1.0)})
    curve = [F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"h{i}_{j}") for i in range(k) for j in range(k)]
    first = now.agg(F.sum("n_tokens").alias("tokens"), *curve).first()
    tokens = first["tokens"]
    if not tokens:
        return []
    # The steepest curvature is at most the largest row sum of the matrix of posterior products.
    rate = 1 / max(sum(first[f"h{i}_{j}"] for j in range(k)) / tokens for i in range(k))
    steps: list[tuple[list[float], float]] = []
    momentum, before = 1.0, math.inf
    with Steps(soft.sparkSession) as kept:
        for n in range(most):
            sums = now.agg(*(F.sum(F.col("n_tokens") * F.col(v) * F.get("p", F.lit(i))).alias(f"{v}{i}") for v in ("r", "y") for i in range(k))).first()
            off = [sums[f"r{i}"] / tokens - goal[i] for i in range(k)]
            error = sum(x * x for x in off)
            if max(map(abs, off)) <= tolerance:
                break
            if error > before:  # overshot: momentum starts anew
                momentum = 1.0
            before = error
            grown = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
            step = ([rate * (sums[f"y{i}"] / tokens - goal[i]) for i in range(k)], (momentum - 1) / grown)
            steps.append(step)
            momentum = grown
            now = now.withColumn("s", F.greatest(F.lit(0.0), F.col("y") - _dot("p", step[0])))
            now = now.select("n_tokens", "p", F.col("s").alias("r"), (F.col("s") + _dot(F.array(F.col("s") - F.col("r")), [step[1]])).alias("y"))
            if n % every == every - 1:
                now = kept.stored(now)
        else:
            sums = now.agg(*(F.sum(F.col("n_tokens") * F.col("r") * F.get("p", F.lit(i))).alias(f"r{i}") for i in range(k))).first()
            off = [sums[f"r{i}"] / tokens - goal[i] for i in range(k)]
            if max(map(abs, off)) > tolerance:
                warnings.warn(f"after {most} steps the domains' shares are off their targets by {[round(x, 4) for x in off]}", stacklevel=2)
    return steps


def apply_steps(steps: list[tuple[list[float], float]]) -> Column:
    """The rate that the steps give a document with posterior p."""
    if not steps:
        return F.lit(1.0)
    taken = F.transform(F.from_json(F.lit(json.dumps([[*slope, beta] for slope, beta in steps])), "array<array<double>>"), lambda s: s)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))

    def one(state: Column, step: Column) -> Column:
        k = F.size("p")
        moved = F.greatest(F.lit(0.0), state["y"] - F.aggregate(F.zip_with("p", F.slice(step, F.lit(1), k), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        return F.struct(moved.alias("r"), (moved + F.get(step, k) * (moved - state["r"])).alias("y"))

    return F.aggregate(taken, start, one)["r"]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample_rows: int = 6000, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, p_<domain> for each target domain, and rate. docs need doc_id and text; other columns are kept,
    but for those that share a name with the added ones. Posteriors are written out once and read by every step."""
    domains = sorted(targets)
    made = ["n_tokens", *(f"p_{d}" for d in domains), "rate"]
    carried = [c for c in docs.columns if c not in ("doc_id", "text", *made)]
    kept = (["text"] if keep_text else []) + carried
    body = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"_{c}") for c in kept)).alias("_row"))
    soft = stored(posteriors(body, labelled, domains, sample_rows).select("doc_id", "n_tokens", "p", "_row"))
    rate = apply_steps(fit_steps(soft, [targets[d] for d in domains]))
    shares = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)]
    # In two steps: a carried column may be called p.
    fitted = soft.select("doc_id", "_row", "n_tokens", *shares, rate.alias("rate"))
    return fitted.select("doc_id", *(F.col("_row").getField(f"_{c}").alias(c) for c in kept), "n_tokens", *(f"p_{d}" for d in domains), "rate")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels(doc_id, quality, toxic): toxic, else low quality, else good; rows with neither label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null").distinct()
