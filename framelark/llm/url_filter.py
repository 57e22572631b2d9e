"""URL filter: host and path rules, and gradient-boosted trees over lexical features.

DataFrame functions only.  A rule (host, path) fits a url whose host is the
rule's or a subdomain of it and whose path starts with the rule's; the longest
rule that fits decides.  A url that no rule fits is judged by trees.

The trees learn from labelled urls, by default those that a rule decides.
Features are length, depth, digit ratio, entropy, parameter counts, host shape
and the smoothed share of blocked urls among those with the same suffix or section.  Every
feature is cut at quantiles of the labelled urls; urls with the same bins
become one weighted cell before boosting, so that a round reads cells, not urls;
a cell keeps the margin of the trees so far.
A round's histograms (node, feature, bin) have a fixed size; only they, the
quantiles and the hashed suffix table reach the driver, where splits are chosen.

Defined results: a null url, or one without "://", has empty host and path and
is judged by the trees on features of an empty url; without labelled urls the
trees allow; equal urls get equal verdicts and repeated rows stay
rows; urls of any length are measured whole; an empty table gives an empty result; other
columns are ignored, names may clash.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TREES, DEPTH, BINS, RATE, PENALTY = 8, 3, 16, 0.5, 1.0
SUFFIX_BUCKETS = 256
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "host_length", "hyphens", "secure", "path_length", "top_suffix", "domain_suffix", "section")
STATISTICS = 3  # the last of FEATURES: blocked shares by suffix and by first path segment
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path; else null."""
    found = F.lit(None).cast("string")
    for _, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, own + start).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    """A rule's verdict; else null."""
    found = F.lit(None).cast("string")
    for verdict, own, start in rules:
        found = F.when(rule == own + start, verdict).otherwise(found)
    return found


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the lexical features that need no statistics, f0 to f9, with the buckets s0 to s2 of suffixes and section."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select("page_id", url.alias("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(F.split("url", "")), lambda c: F.length("url") - F.length(F.replace(F.col("url"), c, F.lit(""))))
    entropy = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / n * F.log(c / n))
    digits = F.length("url") - F.length(F.translate("url", "0123456789", ""))
    count = lambda column, what: (F.length(column) - F.length(F.replace(F.col(column), F.lit(what), F.lit("")))).cast("double")
    values = [
        F.length("url").cast("double"), count("path", "/"), digits / n, entropy, count("url", "&") + count("url", "?"), count("host", "."),
        F.length("host").cast("double"), count("host", "-"), F.col("url").startswith("https:").cast("double"), F.length("path").cast("double"),
    ]
    return parts.select("page_id", "host", "path", *[v.alias(f"f{i}") for i, v in enumerate(values)],
                        _bucket(F.substring_index("host", ".", -1)).alias("s0"), _bucket(F.substring_index("host", ".", -2)).alias("s1"), _bucket(F.substring_index("path", "/", 2)).alias("s2"))


class Trees(NamedTuple):
    #: Per suffix statistic, the blocked share of each bucket.
    suffixes: tuple[tuple[float, ...], ...]
    edges: tuple[tuple[float, ...], ...]
    #: Per tree, the splits (feature, bin) of its inner nodes by heap number, and its leaf values.
    trees: tuple[tuple[dict[int, tuple[int, int]], dict[int, float]], ...]


def _constants(values) -> Column:
    """An array of constants, parsed at once: a call to the JVM for each of them would take longer than the jobs."""
    return F.expr(f"array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})")


def _node(splits: dict[int, tuple[int, int]], levels: int, root: Column) -> Column:
    """Heap number of the node that a row of ``bins`` reaches ``levels`` below ``root``.  Splits
    are read from arrays, so that every tree runs the same generated code."""
    features, edges = (_constants(splits[k][i] for k in range(1, 2**levels)) for i in (0, 1))
    node = root
    for _ in range(levels):
        node = 2 * node + (F.get(F.col("bins"), F.get(features, node - 1)) > F.get(edges, node - 1)).cast("int")
    return node


def _value(splits: dict[int, tuple[int, int]], leaves: dict[int, float], root: Column) -> Column:
    """A tree's value of a row of ``bins``."""
    return F.get(_constants(leaves[k] for k in sorted(leaves)), _node(splits, DEPTH, root) - 2**DEPTH)


def _featured(rows: DataFrame, suffixes) -> DataFrame:
    """Adds f10 to f12, the blocked shares of suffixes and section."""
    for i, shares in enumerate(suffixes):
        rows = rows.withColumn(f"f{10 + i}", F.get(_constants(shares), F.col(f"s{i}")))
    return rows


def _bins(edges) -> Column:
    """``bins``: for each feature, how many of its edges a row exceeds."""
    exceeded = [" + ".join(f"CAST(f{i} > {e!r}D AS INT)" for e in own) for i, own in enumerate(edges)]
    return F.expr(f"array({', '.join(exceeded)})").alias("bins")


def _best(found: dict[tuple[int, int, int], tuple[float, float]], node: int) -> tuple[int, int] | None:
    """The split (feature, bin) of most gain; the first on ties."""
    best, most = None, 1e-6
    for feature in range(len(FEATURES)):
        own = [found.get((node, feature, b), (0.0, 0.0)) for b in range(BINS)]
        g, h = math.fsum(x[0] for x in own), math.fsum(x[1] for x in own)
        left_g = left_h = 0.0
        for b in range(BINS - 1):
            left_g, left_h = left_g + own[b][0], left_h + own[b][1]
            right_g, right_h = g - left_g, h - left_h
            if left_h < 1e-9 or right_h < 1e-9:
                continue
            gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - g**2 / (h + PENALTY)
            if gain > most + 1e-9:
                best, most = (feature, b), gain
    return best


def fit(labelled: DataFrame) -> Trees:
    """Train on ``lexical`` rows with a column ``blocked`` of 0 and 1."""
    rows = cut(labelled)
    at = F.posexplode(F.array(*[f"s{i}" for i in range(STATISTICS)])).alias("i", "s")
    held = rows.select("blocked", at).groupBy("i", "s").agg(F.sum("blocked").alias("b"), F.count("*").alias("n")).collect()
    if not held:
        return Trees((), (), ())
    prior = sum(r.b for r in held) / sum(r.n for r in held)
    shares = [[prior] * SUFFIX_BUCKETS for _ in range(STATISTICS)]
    for r in held:
        shares[r.i][r.s] = (r.b + 10 * prior) / (r.n + 10)
    suffixes = tuple(tuple(float(x) for x in own) for own in shares)
    rows = _featured(rows, suffixes)
    at = [k / BINS for k in range(1, BINS)]
    quantiles = rows.agg(*[F.percentile_approx(f"f{i}", at, 2000).alias(f"q{i}") for i in range(len(FEATURES))]).first()
    edges = tuple(tuple(sorted(set(q))) for q in quantiles)
    cells = rows.select("blocked", _bins(edges)).groupBy("bins").agg(F.count("*").cast("double").alias("n"), F.sum("blocked").cast("double").alias("y"))
    cells = cut(cells.select("bins", "n", "y", F.lit(0.0).alias("margin"), F.lit(1).alias("root")))
    root, trees = F.col("root"), []
    while True:
        chance = 1 / (1 + F.exp(-F.col("margin")))
        state = cells.select("bins", "root", (F.col("n") * chance - F.col("y")).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"))
        splits: dict[int, tuple[int, int]] = {}
        totals: dict[int, tuple[float, float]] = {}
        for level in range(DEPTH):
            items = state.select(_node(splits, level, root).alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
            sums = items.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            found = {(r.node, r.feature, r.bin): (r.g, r.h) for r in sums}
            for node in range(2**level, 2 ** (level + 1)):
                best = _best(found, node) or (0, BINS)  # (0, BINS): all rows go left
                splits[node] = best
                for side in (0, 1):
                    own = [v for (k, f, b), v in found.items() if (k, f) == (node, best[0]) and (b > best[1]) == bool(side)]
                    totals[2 * node + side] = math.fsum(v[0] for v in own), math.fsum(v[1] for v in own)
        leaves = {k: -RATE * totals[k][0] / (totals[k][1] + PENALTY) for k in range(2**DEPTH, 2 ** (DEPTH + 1))}
        trees.append((splits, leaves))
        if len(trees) == TREES:
            return Trees(suffixes, edges, tuple(trees))
        cells = cut(cells.withColumn("margin", F.col("margin") + _value(splits, leaves, root)))


def blocked(rows: DataFrame, model: Trees) -> DataFrame:
    """``lexical`` rows -> page_id, host, path, chance (that the url is one to block)."""
    if not model.trees:
        return rows.select("page_id", "host", "path", F.lit(0.0).alias("chance"))
    binned = _featured(rows, model.suffixes).select("page_id", "host", "path", _bins(model.edges))
    margin = F.lit(0.0)
    for splits, leaves in model.trees:
        margin = margin + _value(splits, leaves, F.lit(1))
    return binned.select("page_id", "host", "path", (1 / (1 + F.exp(-margin))).alias("chance"))


def judge(pages: DataFrame, rules=RULES, model: Trees | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, chance.  Without a model, one is trained on
    the urls that a rule decides."""
    rows = lexical(pages)
    if model is None:
        known = rows.withColumn("_verdict", verdict_of(rule_of(F.col("host"), F.col("path"), rules), rules)).where("_verdict is not null")
        model = fit(known.withColumn("blocked", (F.col("_verdict") == "block").cast("int")).drop("_verdict", "page_id", "host", "path"))
    judged = blocked(rows, model).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("chance") >= 0.5, "block").otherwise("allow")).alias("verdict"), "chance")
