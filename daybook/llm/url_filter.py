"""URL filters: rules by host and path, and boosted trees on lexical features for the rest.

A rule (action, host, path) fits its host and all subdomains where the url's path starts
with the rule's; the longest rule that fits wins. URLs that a rule decides are the labelled
examples (block = 1); gradient-boosted trees learn from them and judge the others.

Features are the url's length, depth, shares and counts of characters, entropy, number of
parameters, and suffix statistics: the share of block, smoothed by the overall share, among
all labelled urls with the same host suffix, file suffix or first directory. The statistics
are counted over all labelled urls; only the trees learn from a sample.

Everything is DataFrame functions. Features are binned by quantiles of the sample; equal
binned rows are summed up; each level of a tree is one aggregation of gradients by (node,
feature, bin), of at most ``2^depth * features * bins`` rows, from which the driver takes
the splits; a tree is then a ``CASE`` expression. ``sample`` bounds the labelled rows learnt
from, by a threshold on a hash of the url, so that the same urls are taken every time.
``urls`` are all judged.

Defined cases. Null url or one without ``://``: host and path empty, no rule, judged by its
features (those of an empty url). Very long urls: all features are linear, but for the
entropy, which sorts the characters. Without labelled rows of both kinds the score is the
share of block (0.5 without any). Ties: of rules of one length the first in alphabetical
order; a score of exactly 0.5 is block; of equal splits the first feature's lowest. Repeated
rows get the same verdict. Only id and url are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import ascii_lower, hot_keys, hot_limit, spread_join, written

FEATURES = ("length", "host_length", "depth", "digits", "entropy", "params", "labels", "hyphens", "suffix_rate", "file_rate", "directory_rate")
#: The parts of a url whose share of block is counted.
SUFFIXES = ("suffix", "file", "directory")
#: Statistics of at most so many values (some 50 bytes each) are sent; more meet the urls by shuffle.
SENT_VALUES = 200_000
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    host = ascii_lower(F.regexp_extract(u, _AFTER, 1))
    return urls.withColumns({"host": host, "path": F.regexp_extract(u, _AFTER, 2)})


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) for columns ``host`` and ``path``; null where none fits."""
    name = action = None
    for act, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, action)


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    chars = F.sort_array(F.split(text, ""))

    def bits(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(0.0)

    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        chars,
        start,
        lambda a, c: F.struct(
            c.alias("c"),
            F.when(c == a["c"], a["n"] + 1.0).otherwise(1.0).alias("n"),
            F.when(c == a["c"], a["s"]).otherwise(a["s"] + bits(a["n"])).alias("s"),
        ),
        lambda a: a["s"] + bits(a["n"]),
    )
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - total / F.greatest(n, F.lit(1.0))).otherwise(0.0)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` (with host and path) with the features that need no statistics, and the
    suffixes that do."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digits": F.regexp_count(u, F.lit("[0-9]")) / n,
            "entropy": _entropy(u),
            "params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "file": F.regexp_extract("path", r"\.([^./]*)$", 1),
            "directory": F.regexp_extract("path", r"^/([^/]*)", 1),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(kind, value, n, pos) over all rows of ``lexical`` urls with ``label``."""
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in SUFFIXES))
    each = labelled.select("label", F.explode(values).alias("x")).select("x.*", "label")
    return written(each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")), "url_suffixes")


def with_rates(df: DataFrame, statistics: DataFrame, prior: float, prior_rows: float, rows: int) -> DataFrame:
    """``df`` with ``<kind>_rate`` for each kind of suffix; ``prior`` for values never seen.
    ``rows``: how many rows ``df`` has."""
    rate = (F.col("pos") + prior * prior_rows) / (F.col("n") + prior_rows)
    sent = statistics.count() <= SENT_VALUES
    df = df.withColumn("__at", F.monotonically_increasing_id())
    for kind in SUFFIXES:
        own = statistics.filter(F.col("kind") == kind).select(F.col("value").alias(kind), rate.alias(f"{kind}_rate"), "n")
        if sent:
            df = df.join(F.broadcast(own.drop("n")), kind, "left")
        else:
            counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("c"))
            hot = written(hot_keys(counts, [kind], hot_limit(rows)), "hot_values")
            df = spread_join(df, own.drop("n"), [kind], hot, F.xxhash64("__at"), "left")
        df = df.withColumn(f"{kind}_rate", F.coalesce(f"{kind}_rate", F.lit(prior)))
    return df.drop("__at")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


class BoostedTrees:
    """Binary gradient boosting on binned features: Newton steps, ``depth`` levels a tree."""

    def __init__(self, trees: int = 12, depth: int = 3, rate: float = 0.4, bins: int = 16, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.cuts: dict[str, list[float]] = {}
        self.base, self.forest = 0.0, []

    def binned(self, df: DataFrame) -> DataFrame:
        """Adds ``b_<feature>``: how many cuts lie at or below the value."""
        cols = {}
        for f in FEATURES:
            b = F.lit(0)
            for c in self.cuts[f]:
                b = b + (F.col(f) >= c).cast("int")
            cols[f"b_{f}"] = b
        return df.withColumns(cols)

    def _tree(self, node: dict) -> Column:
        if "value" in node:
            return F.lit(node["value"])
        left, right = self._tree(node["left"]), self._tree(node["right"])
        return F.when(F.col("b_" + node["feature"]) <= node["bin"], left).otherwise(right)

    def _leaf_number(self, node: dict) -> Column:
        if "feature" not in node:
            return F.lit(node["leaf"])
        return F.when(F.col("b_" + node["feature"]) <= node["bin"], self._leaf_number(node["left"])).otherwise(
            self._leaf_number(node["right"])
        )

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.forest:
            out = out + self._tree(tree)
        return out

    def fit(self, df: DataFrame, label: str) -> BoostedTrees:
        quantiles = df.approxQuantile(list(FEATURES), [i / self.bins for i in range(1, self.bins)], 0.001)
        self.cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, quantiles or [[]] * len(FEATURES), strict=True)}
        keys = [f"b_{f}" for f in FEATURES]
        data = self.binned(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
        # Bounded by the sample: one partition, so that a level needs no shuffle.
        data = written(data.coalesce(1), "url_vectors").coalesce(1)
        n, pos = data.agg(F.sum("n"), F.sum("pos")).first()
        share = (pos or 0) / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        if not n or pos in (0, n):
            return self
        for _ in range(self.trees):
            self.forest.append(self._grow(data))
        return self

    def _grow(self, data: DataFrame) -> dict:
        p = F.col("p")
        data = data.withColumn("p", _sigmoid(self.margin()))
        data = data.withColumns({"g": F.col("pos") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        root: dict = {"leaf": 0}
        leaves = [root]
        for level in range(self.depth + 1):
            feature_bins = F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b_{f}").alias("b")) for k, f in enumerate(FEATURES)))
            sums = (
                data.select(self._leaf_number(root).alias("leaf"), "g", "h", F.explode(feature_bins).alias("x"))
                .groupBy("leaf", "x.f", "x.b")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )
            grown = []
            for node in leaves:
                rows = [r for r in sums if r.leaf == node["leaf"]]
                g, h = (sum(r[k] for r in rows if r.f == 0) for k in ("g", "h"))
                split = self._split(rows, g, h) if level < self.depth else None
                number = node["leaf"]
                if split is None:
                    node |= {"value": self.rate * g / (h + self.least), "leaf": number}
                    continue
                left, right = {"leaf": 2 * number + 1}, {"leaf": 2 * number + 2}
                node |= {"feature": FEATURES[split[0]], "bin": split[1], "left": left, "right": right}
                grown += [left, right]
            leaves = grown
            if not leaves:
                break
        return root

    def _split(self, rows: list, g: float, h: float) -> tuple[int, int] | None:
        def score(a: float, b: float) -> float:
            return a * a / (b + self.least)

        best, where = 1e-6, None
        for f in range(len(FEATURES)):
            lg = lh = 0.0
            for r in sorted((r for r in rows if r.f == f), key=lambda r: r.b):
                lg, lh = lg + r.g, lh + r.h
                gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                if gain > best and min(lh, h - lh) > 1e-9:
                    best, where = gain, (f, r.b)
        return where


def judge(
    urls: DataFrame, rules: list[tuple[str, str, str]], sample: int = 20_000, prior_rows: float = 10.0,
    id_column: str = "page_id", url_column: str = "url", model: BoostedTrees | None = None, keep: Column | None = None,
) -> DataFrame:
    """One row per row of ``urls``: ``page_id, url, host, path, rule, score, verdict``.
    ``keep``: a condition on ``url`` for the labelled rows that may be learnt from."""
    name, action = rule_of(rules)
    known = parts(urls.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")))
    known = known.withColumns({"rule": name, "action": action})
    labelled = known.filter("action IS NOT NULL").withColumn("label", (F.col("action") == "block").cast("int"))
    labelled = labelled.filter(keep) if keep is not None else labelled
    statistics = suffix_statistics(lexical(labelled))
    n, block = statistics.filter(F.col("kind") == SUFFIXES[0]).agg(F.sum("n"), F.sum("pos")).first()
    prior = block / n if n else 0.5
    share = F.pmod(F.xxhash64(F.lit(17), "url"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n or 0, 1)))
    train = with_rates(lexical(labelled.filter(share)), statistics, prior, prior_rows, sample)
    model = (model or BoostedTrees()).fit(written(train, "url_sample"), "label")
    full = with_rates(lexical(known), statistics, prior, prior_rows, n or 0)
    scored = model.binned(full).withColumn("score", _sigmoid(model.margin()))
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select("page_id", "url", "host", "path", "rule", "score", "verdict")
