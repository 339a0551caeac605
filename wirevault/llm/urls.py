"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Features are taken from the URL's text alone: lengths, depth, shares of digits and of other marks,
entropy, numbers of parameters and labels, hyphens, runs without a vowel, and how often labelled URLs
of its suffix are bad. Trees are grown on a bounded sample of labelled URLs, the same on every run, and
then judge every URL in Arrow batches; the model is a few kilobytes. `rule_skill` tells how well a model
judges the URLs of a rule that it was not taught.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import BROADCAST_ROWS, hot_keys, lookup
from ..session import stored_once

# The rules, each a host and a path, and what they decide.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
SAMPLE_ROWS = 20_000
PRIOR_ROWS = 20.0
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 40, 3, 0.2, 32, 20, 1.0
FEATURES = (
    "url length", "host length", "path length", "depth", "labels", "digit ratio", "mark ratio", "entropy",
    "host entropy", "parameters", "query length", "suffix rate", "host hyphens", "host run without vowels",
)
_NO_VOWELS = re.compile("[b-df-hj-np-tv-xz]+")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> Column:
    """`host` and `path` of a URL; both empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return F.struct(
        F.translate(F.regexp_extract(found, pattern, 1), _UPPER, _UPPER.lower()).alias("host"),
        F.regexp_extract(found, pattern, 2).alias("path"),
    )


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits and its verdict; null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features(url: str | None, host: str, path: str, rate: float) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(map(str.isdigit, url)) / n,
        sum(not c.isalnum() for c in url) / n, _entropy(url), _entropy(host),
        query.count("=") if query else 0, len(query), rate, host.count("-"),
        max(map(len, _NO_VOWELS.findall(host)), default=0),
    ]


@dataclass
class Forest:
    """Trees of fixed depth: split features and limits by heap order, and leaf values."""

    base: float
    split: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def totals(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Log odds by no tree, the first tree, the first two and so on."""
        total = np.full(len(x), self.base)
        yield total
        for split, limit, leaf in zip(self.split, self.limit, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                right = x[np.arange(len(x)), split[node]] > limit[node]
                node = 2 * node + 1 + right
            total = total + leaf[node - (2**DEPTH - 1)]
            yield total

    def probability(self, x: np.ndarray) -> np.ndarray:
        for total in self.totals(x):
            pass
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, bad: np.ndarray, trees: int = TREES) -> Forest:
    """Boosting of the logistic loss on binned features. One class, or no rows: a constant."""
    inner = 2**DEPTH - 1
    share = (bad.sum() + 0.5) / (len(bad) + 1) if len(bad) else 0.0
    base = math.log(share / (1 - share)) if 0 < share < 1 else -10.0
    split, limit, leaf = [], [], []
    if len(bad) and 0 < bad.sum() < len(bad):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        score = np.full(len(bad), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = bad - p, p * (1 - p)
            s, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(bad), dtype=np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = node == k
                    s[k], c[k], at = _best_split(binned, cuts, gradient, weight, rows)
                    node[rows] = 2 * k + 1 + (binned[rows, s[k]] > at)
            node -= inner
            g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
            values = RATE * g / (h + PENALTY)
            score += values[node]
            split.append(s), limit.append(c), leaf.append(values)
    return Forest(base, np.array(split, np.int64).reshape(-1, inner), np.array(limit).reshape(-1, inner), np.array(leaf).reshape(-1, inner + 1))


def _best_split(binned, cuts, gradient, weight, rows) -> tuple[int, float, int]:
    best = (1e-9, 0, np.inf, BINS)
    g, h = gradient[rows].sum(), weight[rows].sum()
    for f, limits in enumerate(cuts):
        b, m = binned[rows, f], len(limits) + 1
        gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (gradient[rows], weight[rows], None))
        if not len(gl):
            continue
        gain = gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g**2 / (h + PENALTY)
        gain[(nl < LEAST_ROWS) | (rows.sum() - nl < LEAST_ROWS)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, float(limits[k]), k)
    return best[1:]


def grow_checked(x: np.ndarray, bad: np.ndarray, held: np.ndarray) -> Forest:
    """As many trees as lower the loss of the held rows most, then grown on all rows.

    Signs that only tell the taught hosts apart do not help on other hosts, so none of them is kept.
    """
    if not held.any() or held.all():
        return grow(x, bad)
    sign = np.where(bad[held] > 0, -1.0, 1.0)
    losses = [np.logaddexp(0, sign * total).mean() for total in grow(x[~held], bad[~held]).totals(x[held])]
    return grow(x, bad, int(np.argmin(losses)))


@dataclass
class UrlModel:
    """Trees, a stored table of suffixes and their rates, and the rate of any other suffix."""

    forest: Forest
    rates: DataFrame
    n_rates: int
    overall: float

    def with_rate(self, urls: DataFrame) -> DataFrame:
        """Add `rate`, and whether it is the suffix's own, to rows with a suffix and a page_id.

        Hot suffixes are split if many have rates.
        """
        hot = None
        if self.n_rates > BROADCAST_ROWS:
            hot = hot_keys(urls.groupBy("suffix").agg(F.count("*").alias("n")), "suffix", "n")
        found = lookup(urls, self.rates, "suffix", table_key="suffix", table_rows=self.n_rates, hot=hot, row_id="page_id")
        return found.withColumns(
            {"own_rate": F.col("rate").isNotNull(), "rate": F.coalesce("rate", F.lit(float(self.overall)))}
        )


def fit(labelled: DataFrame, *, rows: int = SAMPLE_ROWS) -> UrlModel:
    """Learn from `labelled` (url, bad): suffix rates from all of them, trees from `rows` of them.

    The sample is the rows of lowest hash. Rates are shrunk towards the overall rate. A suffix whose
    labels are all of one class gets the overall rate: its own would only repeat where labels came from.
    For the same reason trees are taught by such suffixes only where no suffix has labels of both
    classes. The number of trees is checked on a fifth of the hosts. Counts and rates of suffixes stay
    in stored tables; only the sample reaches the driver.
    """
    known = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(
        "url", F.col("bad").cast("int").alias("bad"), url_parts(F.col("url")).alias("_p")
    ).select("url", "bad", "_p.host", "_p.path", suffix_of(F.col("_p.host")).alias("suffix"))
    counts, _ = stored_once(known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "suffix-counts")
    total = counts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (total[1] or 0) / total[0] if total[0] else 0.0
    rate = (F.col("bad") + PRIOR_ROWS * overall) / (F.col("n") + PRIOR_ROWS)
    rates, n_rates = stored_once(counts.where("bad > 0 AND bad < n").select("suffix", rate.alias("rate")), "suffix-rates")
    model = UrlModel(grow(np.empty((0, len(FEATURES))), np.empty(0)), rates, n_rates, overall)
    rated = model.with_rate(known.withColumn("page_id", F.xxhash64("url")))
    if n_rates:
        rated = rated.where("own_rate")
    # Stored first: a sorted limit that is collected sends the best rows of every task to the driver.
    lowest, _ = stored_once(rated.orderBy("page_id", "url", "bad").limit(rows), "url-sample")
    sample = sorted(lowest.collect(), key=lambda r: (r["page_id"], r["url"], r["bad"]))
    x = np.array([features(r["url"], r["host"], r["path"], r["rate"]) for r in sample], dtype=np.float64)
    bad = np.array([r["bad"] for r in sample], dtype=np.float64)
    held = np.array([crc32(r["host"].encode()) % 5 == 0 for r in sample], dtype=bool)
    model.forest = grow_checked(x.reshape(-1, len(FEATURES)), bad, held)
    return model


def judged(pages: DataFrame, model: UrlModel, *, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per row of `pages` (page_id, url): host, path, rule, verdict and `score`, the model's.

    A rule's verdict stands; else the model blocks from `threshold` on. A null URL, or one without
    `://`, has an empty host and path, fits no rule and is judged like others. Repeated rows are
    repeated; other columns are not read.
    """
    found = pages.select("page_id", "url", url_parts(F.col("url")).alias("_p")).select(
        "page_id", "url", "_p.host", "_p.path", suffix_of(F.col("_p.host")).alias("suffix"),
    )
    forest = model.forest

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = (batch.column(c).to_pylist() for c in ("url", "host", "path", "rate"))
            x = np.array([features(*r) for r in zip(*columns)], dtype=np.float64)
            scores = forest.probability(x.reshape(-1, len(FEATURES)))
            kept = ["page_id", "host", "path"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    out = T.StructType([*(found.schema[c] for c in ("page_id", "host", "path")), T.StructField("score", T.DoubleType())])
    scored = model.with_rate(found).mapInArrow(batches, out).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "score"
    )


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """`url, bad` of the URLs that a rule decides: labels where there are no others."""
    parts = pages.select("url", url_parts(F.col("url")).alias("_p"))
    verdict = fitting_rule(F.col("_p.host"), F.col("_p.path"), rules)["verdict"]
    return parts.select("url", (verdict == "block").alias("bad")).where("bad IS NOT NULL")


def rule_skill(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per rule: `rule, verdict, n_urls, n_right`, judged by a model that was taught by the other rules only.

    The URLs of a rule are those it decides among all rules. A share of right verdicts near that of a
    constant verdict means that the rules' labels teach nothing about other URLs. A null URL has no rule;
    a rule that decides nothing has no row; repeated rows count each.
    """
    parts = pages.select("url", url_parts(F.col("url")).alias("_p"))
    ruled = parts.select("url", fitting_rule(F.col("_p.host"), F.col("_p.path"), rules).alias("_rule"))
    ruled, _ = stored_once(ruled.where("_rule IS NOT NULL").select("url", "_rule.*"), "ruled-urls")
    bad = (F.col("verdict") == "block").alias("bad")
    parts = []
    for rule, verdict in rules:
        mine = F.col("rule") == rule
        model = fit(ruled.where(~mine).select("url", bad))
        left_out = ruled.where(mine).select(F.xxhash64("url").alias("page_id"), "url")
        right = judged(left_out, model, rules=()).groupBy().agg(
            F.count("*").alias("n_urls"), F.count_if(F.col("verdict") == verdict).alias("n_right")
        )
        parts.append(right.where("n_urls > 0").select(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), "*"))
    return reduce(DataFrame.unionByName, parts)
