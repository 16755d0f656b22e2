"""Secret scans, with DataFrame functions only.

Base spans come from three patterns. The method adds tokens that look uniformly random: a token is a maximal run of
[A-Za-z0-9+/=_-] that has 16 characters or more and, in the encoding inferred for it, 64 bits or more. Tokens without a
digit have encodings, and so strata, of their own.
Its symbols pass a battery of three tests: chi-squared uniformity over the alphabet (in the form of the number of equal
pairs, which stays valid for short tokens), runs about the alphabet's middle, and lag-one serial correlation. The three
p-values are combined by the Cauchy rule.

In each stratum of encoding and length, the lowest threshold is taken at which the expected share of structured tokens
among the accepted is at most FALSE_SHARE; a stratum without such a threshold accepts none. What is expected comes from
data that the threshold doesn't fix: how often structured tokens reach it is read off those that share their first
PREFIX_BITS bits with a different token, as random ones don't; how many structured tokens there are, off the p-values under REFUTED.
A stratum of under SMALL tokens takes the threshold of its encoding at all lengths, or that of all tokens if its encoding is as small; a single
token in its stratum is tested so too. No threshold is below the least of THRESHOLDS, so a token that the battery refutes is never added.

Null and empty texts have no spans. Positions are code points, ends exclusive. A span of kind assign is the whole match. Every row is
scanned for itself and gives one row, also where rows repeat or share a doc_id; an empty table gives an empty result, and other columns are left
out, whatever their names. A task holds one whole text and its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import stored

FALSE_SHARE = 0.1
MIN_LENGTH = 16
MIN_BITS = 64
PREFIX_BITS = 40
REFUTED = 0.001
#: The rate at which all structured tokens reach a threshold counts as so many of a stratum's own.
POOLED = 10
SMALL = 30
THRESHOLDS = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5]

# The three patterns of the base scan, as the contract states them; (?i:) holds for A-Z only.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]

# Runs of under 16 hexadecimal digits and keys of under 18 signs fail, and can't hide a longer match: look for long ones only.
_LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
_LONG_HEX = r"[0-9a-f]{16,}"
_SIGN = "[A-Za-z0-9+/=_-]"
_TOKEN = rf"(?<!{_SIGN}){_SIGN}{{{MIN_LENGTH},}}+"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The first, and so narrowest, alphabet that holds a token's symbols is its encoding.
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("lower", "^[a-z]+$", _LOWER),
    ("UPPER", "^[A-Z]+$", _UPPER),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("signs", "^[A-Za-z+/]+$", _UPPER + _LOWER + "+/"),
    ("base32", "^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "", _DIGITS + _UPPER + _LOWER + "+/"),
]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, body>> of the leftmost non-overlapping matches. What split() leaves between the matches
    and the matches themselves alternate, so their lengths add up to the positions."""
    p = _quoted(pattern)
    hits, bodies = (f"regexp_extract_all({text}, {p}, {g})" for g in (0, group))
    gaps = f"slice(split({text}, {p}, -1), 1, size({hits}))"
    steps = f"zip_with(zip_with({gaps}, {hits}, (g, m) -> named_struct('gap', length(g), 'long', length(m))), {bodies}, (x, b) -> named_struct('gap', x.gap, 'long', x.long, 'body', b))"
    found = f"""aggregate({steps}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,body:string>>)),
        (a, x) -> named_struct('at', a.at + x.gap + x.long, 'out', a.out || array(named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.long, 'body', x.body)))).out"""
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {found} ELSE cast(array() as array<struct<start:int,end:int,body:string>>) END")


def _tail(z: str) -> str:
    """P(Z > z) for a standard normal Z, to about 0.0002."""
    return f"(1 / (1 + exp(least(700D, greatest(-700D, 1.5976 * ({z}) + 0.07056 * pow({z}, 3))))))"


def battery(docs: DataFrame) -> DataFrame:
    """docs with `tokens` array<struct<start, end, body>> gets each token's encoding, length n, combined p-value,
    and the hashes of its first PREFIX_BITS bits and of the whole."""
    encoding = "CASE " + " ".join(f"WHEN t.body RLIKE '{rule}' THEN '{name}'" for name, rule, _ in ENCODINGS if rule) + " ELSE 'base64' END"
    alphabet = "CASE t.encoding " + " ".join(f"WHEN '{name}' THEN '{signs}'" for name, _, signs in ENCODINGS) + " END"
    steps = [
        "transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'body', translate(rtrim('=', t.body), '=-_', if(t.body RLIKE '[0-9]', '0+/', '++/'))))",
        f"transform(filter(tokens, t -> length(t.body) >= {MIN_LENGTH}), t -> named_struct('start', t.start, 'end', t.end, 'body', t.body, 'encoding', {encoding}))",
        f"transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'body', t.body, 'encoding', t.encoding, 'signs', {alphabet}))",
        f"filter(tokens, t -> length(t.body) * log2(length(t.signs)) >= {MIN_BITS})",
        f"transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', xxhash64(left(t.body, cast(ceil({PREFIX_BITS} / log2(length(t.signs))) as int))), 'whole', xxhash64(t.body), 'a', cast(length(t.signs) as double), 'x', transform(split(t.body, ''), c -> instr(t.signs, c) - 1)))",
        """transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', t.prefix, 'whole', t.whole, 'a', t.a, 'n', cast(size(t.x) as double),
             'same', aggregate(array_sort(t.x), named_struct('v', -1, 'run', 0L, 'sum', 0L), (s, v) -> named_struct('v', v, 'run', if(s.v = v, s.run + 1L, 0L), 'sum', s.sum + if(s.v = v, s.run + 1L, 0L))).sum,
             'f', aggregate(t.x, named_struct('v', -1, 'high', 0D, 'runs', 0D, 's', 0D, 'ss', 0D, 'sv', 0D), (s, v) -> named_struct('v', v, 'high', s.high + if(v * 2 >= t.a, 1D, 0D),
                  'runs', s.runs + if(s.v < 0 or (s.v * 2 >= t.a) <> (v * 2 >= t.a), 1D, 0D), 's', s.s + v, 'ss', s.ss + v * v, 'sv', s.sv + if(s.v < 0, 0, s.v * v))),
             'first', t.x[0], 'last', t.x[size(t.x) - 1]))""",
        """transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', t.prefix, 'whole', t.whole, 'n', t.n,
             'z_same', (t.same - t.n * (t.n - 1) / 2 / t.a) / sqrt(t.n * (t.n - 1) / 2 / t.a * (1 - 1 / t.a)),
             'pairs', 2 * t.f.high * (t.n - t.f.high), 'runs', t.f.runs, 'm', t.f.s / t.n, 'var', t.f.ss - t.f.s * t.f.s / t.n,
             'cov', t.f.sv - t.f.s / t.n * (2 * t.f.s - t.first - t.last) + (t.n - 1) * pow(t.f.s / t.n, 2)))""",
        """transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', t.prefix, 'whole', t.whole, 'n', t.n, 'z_same', t.z_same,
             'z_runs', if(t.pairs <= t.n, 40D, (t.runs - 1 - t.pairs / t.n) / sqrt(t.pairs * (t.pairs - t.n) / (t.n * t.n * (t.n - 1)))),
             'z_serial', if(t.var <= 0, 40D, t.cov / t.var * sqrt(t.n))))""",
        f"""transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', t.prefix, 'whole', t.whole, 'n', t.n,
             'odd', tan(pi() * (0.5 - {_tail('t.z_same')} * 0.9998 - 0.0001)) + tan(pi() * (0.5 - least(1D, 2 * {_tail('abs(t.z_runs)')}) * 0.9998 - 0.0001)) + tan(pi() * (0.5 - least(1D, 2 * {_tail('abs(t.z_serial)')}) * 0.9998 - 0.0001))))""",
        "transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'encoding', t.encoding, 'prefix', t.prefix, 'whole', t.whole, 'band', cast(floor(log2(t.n)) as int), 'p', 0.5 - atan(t.odd / 3) / pi()))",
    ]
    for step in steps:
        docs = docs.withColumn("tokens", F.expr(step))
    return docs


def thresholds(tokens: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[str, int], float]:
    """The accepting threshold of each (encoding, band) stratum that has one. There are twelve encodings and one band for
    each doubling of the length, so what reaches the driver is a few dozen rows."""
    levels = range(len(THRESHOLDS))
    alike = tokens.groupBy("encoding", "band", "prefix").agg(F.count("*").alias("n"), *(F.count_if(F.col("p") >= t).alias(f"r{k}") for k, t in enumerate(THRESHOLDS)), F.count_if(F.col("p") < REFUTED).alias("refuted"), (F.min("whole") < F.max("whole")).alias("shared"))
    known = [F.sum(F.when(F.col("shared"), F.col(c)).otherwise(0)).alias(f"known_{c}") for c in ("n", *(f"r{k}" for k in levels))]
    rows = alike.groupBy("encoding", "band").agg(F.sum("n").alias("n"), *(F.sum(f"r{k}").alias(f"r{k}") for k in levels), *known, F.sum("refuted").alias("refuted")).collect()

    def pooled(same) -> dict[str, int]:
        return {c: sum(row[c] for row in rows if same(row)) for c in (rows[0].asDict() if rows else ()) if c not in ("encoding", "band")}

    every = pooled(lambda row: True)
    out = {}
    for row in rows:
        own = row.asDict()
        if own["n"] < SMALL:
            own = pooled(lambda other, row=row: other["encoding"] == row["encoding"])
        if own["n"] < SMALL:
            own = every
        # Shares of structured tokens that reach each threshold; with no such token known they are a half.
        reach = [(own[f"known_r{k}"] + POOLED * (every[f"known_r{k}"] + 1) / (every["known_n"] + 2)) / (own["known_n"] + POOLED) for k in levels]
        structured = min(own["n"], max(0.0, own["refuted"] + 1 - REFUTED * own["n"]) / (1 - reach[THRESHOLDS.index(REFUTED)]))
        for k, t in enumerate(THRESHOLDS):
            if own[f"r{k}"] and structured * reach[k] <= false_share * own[f"r{k}"]:
                out[row["encoding"], row["band"]] = t
                break
    return out


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, found, random): base spans as array<struct<start, rank, end>> in order, and the spans that the method adds."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    held = text.select("doc_id", matches("body", ASSIGN, 2).alias("assign"), matches("body", _LONG_ACCESS).alias("access"), matches("body", _LONG_HEX).alias("hex"), matches("body", _TOKEN).alias("tokens"))
    ranked = [f"transform({'filter(assign, x -> length(x.body) >= 12)' if kind == 'assign' else kind}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end))" for rank, kind in enumerate(KINDS[:3])]
    tested = stored(battery(held.select("doc_id", F.expr(f"array_sort(concat({', '.join(ranked)}))").alias("found"), "tokens")))
    lines = thresholds(tested.select(F.explode("tokens").alias("t")).select("t.*"), false_share)
    accept = " OR ".join(f"(t.encoding = '{e}' AND t.band = {b} AND t.p >= {p}D)" for (e, b), p in sorted(lines.items())) or "false"
    random = f"transform(filter(tokens, t -> {accept}), t -> named_struct('start', t.start, 'rank', 3, 'end', t.end))"
    return tested.select("doc_id", "found", F.expr(random).alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda spans: f"array_join(transform({spans}, s -> concat({names}[s.rank], ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(found, s -> s.rank = {rank})) as long)").alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("found")), 256).alias("base_sha256"), F.expr(joined("array_sort(concat(found, random))")).alias("spans"))
