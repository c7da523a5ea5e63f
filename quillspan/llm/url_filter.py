"""URL filter: listed rules first, gradient-boosted trees on lexical features for the rest.

Features are built-in expressions (lengths, path depth, digit and hyphen ratios, character entropy, parameter
counts, block rates by suffix). Trees are fitted on the driver from a bounded sample of labelled
URLs (``most`` rows, taken by the order of a hash) and turned into nested CASE expressions, so judging is one
scan with no shuffle and no Python on the executors.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the trees; repeated
rows are judged alike; an empty table gives an empty result; columns with clashing names are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspan.llm.common import ascii_lower

#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "query_len", "tld_rate", "ext_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, after, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""
    fits, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        hit = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        fits, says = F.when(hit, F.lit(rule)).otherwise(fits), F.when(hit, F.lit(verdict)).otherwise(says)
    return fits, says


def suffixes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5}|/)$", 1)


def features(df: DataFrame, url: str, tld_rate: dict[str, float], ext_rate: dict[str, float], prior: float) -> DataFrame:
    """``df`` with host, path and one double per feature."""
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    host, path, whole = F.col("host"), F.col("path"), F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    tld, ext = suffixes(host, path)
    letters = F.filter(F.split(host, ""), lambda c: c != "")
    total = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / total
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    count = lambda text, p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    rate = lambda key, known: reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(acc), sorted(known.items()), F.lit(prior))
    values = (
        F.length(whole), F.length(host), F.length(path), count(path, "/"), count(host, r"\."),
        count(whole, "[0-9]") / F.greatest(F.length(whole), F.lit(1)), count(host, "-"), entropy,
        count(query, "="), F.length(query), rate(tld, tld_rate), rate(ext, ext_rate),
    )
    return df.withColumns({f"f_{n}": v.cast("double") for n, v in zip(FEATURES, values, strict=True)})


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[float, list]:
    """Boosted regression trees for the logistic loss; a tree is a number or (feature, threshold, left, right)."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, trees = np.full(len(y), base), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 32))) for j in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        value = lambda r: float(rate * g[r].sum() / (h[r].sum() + ridge))
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
        best = (1e-6, None)
        if level:
            for j, thresholds in enumerate(cuts):
                for t in thresholds:
                    left = rows[x[rows, j] <= t]
                    if 5 <= len(left) <= len(rows) - 5:
                        right = rows[x[rows, j] > t]
                        if (won := gain(left) + gain(right) - gain(rows)) > best[0] + 1e-9:
                            best = (won, (j, float(t), left, right))
        if best[1] is None:
            return value(rows)
        j, t, left, right = best[1]
        return j, t, grow(left, g, h, level - 1), grow(right, g, h, level - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        score = score + predict(tree, x)
    return base, trees


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, left, right = tree
    return np.where(x[:, j] <= t, predict(left, x), predict(right, x))


def score_column(base: float, trees: list) -> Column:
    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        j, t, left, right = tree
        return F.when(F.col(f"f_{FEATURES[j]}") <= t, of(left)).otherwise(of(right))

    return reduce(lambda acc, tree: acc + of(tree), trees, F.lit(base))


class UrlModel:
    """Fitted from labelled URLs (``url``, ``block`` 0 or 1)."""

    def __init__(self, labelled: DataFrame, most: int = 20_000, rounds: int = 40, depth: int = 3):
        host, path = host_and_path(F.col("url"))
        tld, ext = suffixes(host, path)
        sample = labelled.where("block is not null").orderBy(F.xxhash64("url"), "url").limit(most).select("url", "block", tld.alias("tld"), ext.alias("ext"))
        rows = sample.toPandas()
        self.prior = float((rows.block.sum() + 1) / (len(rows) + 2))
        smooth = lambda key: {str(k): round(float((v.sum() + 8 * self.prior) / (len(v) + 8)), 6) for k, v in sorted(rows.groupby(key).block, key=lambda kv: -len(kv[1]))[:200]}
        self.tld_rate, self.ext_rate = smooth("tld"), smooth("ext")
        spark = labelled.sparkSession
        given = spark.createDataFrame(rows[["url", "block"]]) if len(rows) else labelled.limit(0)
        fitted = features(given, "url", self.tld_rate, self.ext_rate, self.prior).select("block", *(f"f_{n}" for n in FEATURES)).toPandas()
        x, y = fitted.iloc[:, 1:].to_numpy(np.float64), fitted.block.to_numpy(np.float64)
        order = np.lexsort((y, *x.T))
        self.base, self.trees = fit_trees(x[order], y[order], rounds, depth) if len(y) else (0.0, [])

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """``df`` with host, path, features and ``block_score`` (log odds)."""
        return features(df, url, self.tld_rate, self.ext_rate, self.prior).withColumn("block_score", score_column(self.base, self.trees))


def seed_urls(spark: SparkSession) -> DataFrame:
    """A labelled set made from a rule: names of ordinary hosts and of link farms, over many paths."""
    plain = "news library garden kitchen museum weather science school village music history travel forum market theatre rivers railway bakery choir orchard physics letters harbour cinema atlas".split()
    farm = [f"{a}-{b}" for a in "cheap free win casino spam ads bonus replica loan pills".split() for b in "pills bets farm track casino offers deals cash".split()]
    rows = []
    for k in range(4000):
        block = k % 2
        name = farm[k // 2 % len(farm)] if block else plain[k // 2 % len(plain)] + ("" if k % 6 else "-" + plain[k % 7])
        sub, tld = ("", "www.", "blog.", "m.")[k // 3 % 4], ("com", "org", "net", "info")[k // 5 % 4 if not block or k % 11 else 3]
        tail = ("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top")[k // 7 % 6]
        rows.append((f"http{'s' * (k % 2)}://{sub}{name}.example.{tld}/{('en', 'fr', 'de', 'es')[k // 13 % 4]}/{k * 37 % 997}{tail}", block))
    return spark.createDataFrame(rows, "url string, block int")


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url: str = "url", threshold: float = 0.0) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score."""
    scored = model.score(pages.select(F.col(id_col), F.col(url).alias("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), F.col("block_score").alias("score"))
