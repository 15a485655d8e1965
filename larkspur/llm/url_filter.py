"""URL filter: stated rules, and gradient-boosted trees on lexical features for all other URLs.

The trees are trained on URLs with a label; by default the label is the
verdict of the rule that fits.  Training takes a bounded sample (``SAMPLE``
labelled rows, those with the least hash), everything else covers every URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES = 40
LEVELS = 3
RATE = 0.3
BINS = 32
#: (rule, verdict); a rule is a host and a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What stands between the first "://" and the next "/", "?" or "#", A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to "?" or "#"; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the path's start, and its verdict; else null."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_count")


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def suffixes(host: str) -> str:
    """The last label of a host, without a port."""
    return host.rpartition("@")[2].partition(":")[0].rpartition(".")[2]


@dataclass
class UrlModel:
    """Boosted regression trees on binned features; each tree is complete, with ``LEVELS`` levels."""

    suffix: dict[str, tuple[float, float]] = field(default_factory=dict)
    prior: float = 0.5
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value

    def features(self, urls, hosts, paths) -> np.ndarray:
        rows = []
        for url, host, path in zip(urls, hosts, paths, strict=True):
            url = url or ""
            query = url.partition("?")[2].partition("#")[0]
            rate, count = self.suffix.get(suffixes(host), (self.prior, 0.0))
            rows.append((
                len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / max(1, len(url)), _entropy(url),
                query.count("&") + bool(query), url.count("-"), rate, count,
            ))
        return np.array(rows, float).reshape(-1, len(FEATURES))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, urls, hosts, paths, blocked: np.ndarray) -> UrlModel:
        """Fits suffix statistics, then the trees, by logistic loss."""
        blocked = np.asarray(blocked, float)
        self.prior = (blocked.sum() + 1) / (len(blocked) + 2)
        sums: dict[str, list[float]] = {}
        for h, y in zip(hosts, blocked, strict=True):
            s = sums.setdefault(suffixes(h), [0.0, 0.0])
            s[0] += y
            s[1] += 1
        self.suffix = {k: ((a + 8 * self.prior) / (n + 8), float(np.log1p(n))) for k, (a, n) in sums.items()}
        if not len(blocked) or blocked.min() == blocked.max():
            self.start = float(np.log(self.prior / (1 - self.prior)))
            return self
        x = self.features(urls, hosts, paths)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.start = float(np.log(self.prior / (1 - self.prior)))
        score = np.full(len(blocked), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(b, blocked - p, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """One level at a time, each node takes the split with the most gain (Newton step, ridge 1)."""
        feature, cut = np.zeros((1 << LEVELS) - 1, np.int64), np.full((1 << LEVELS) - 1, BINS + 1)
        node = np.zeros(len(g), np.int64)
        for level in range(LEVELS):
            n, base = 1 << level, (1 << level) - 1
            best = np.full(n, 1e-9)
            for j in range(b.shape[1]):
                key = node * (BINS + 1) + b[:, j]
                gs, hs = (np.bincount(key, w, n * (BINS + 1)).reshape(n, -1).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[base : base + n][better] = j
                cut[base : base + n][better] = at[better]
            i = base + node
            node = 2 * node + (b[np.arange(len(g)), feature[i]] > cut[i])
        size = 1 << LEVELS
        value = RATE * np.bincount(node, g, size) / (np.bincount(node, h, size) + 1)
        return (feature, cut, value), node

    def score(self, urls, hosts, paths) -> np.ndarray:
        """Log-odds that a URL is to be blocked."""
        out = np.full(len(urls), self.start)
        if self.trees and len(urls):
            b = self._binned(self.features(urls, hosts, paths))
            for feature, cut, value in self.trees:
                node = np.zeros(len(b), np.int64)
                for level in range(LEVELS):
                    i = (1 << level) - 1 + node
                    node = 2 * node + (b[np.arange(len(b)), feature[i]] > cut[i])
                out += value[node]
        return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fits a model to ``labelled`` (url, host, path, verdict): at most ``sample`` rows, those with the least hash."""
    rows = labelled.select("url", "host", "path", "verdict").orderBy(F.xxhash64("url"), "url", "verdict").limit(sample).toPandas()
    return UrlModel().fit(rows["url"], rows["host"], rows["path"], (rows["verdict"] == "block").to_numpy())


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url).

    A null url, or one without "://", has an empty host and path; the model
    judges it like any URL that no rule fits.  Rows are independent of one
    another; an empty table gives no rows.  Without labelled rows the model
    blocks at its prior, 1 in 2, so it allows.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    model = rows.sparkSession.sparkContext.broadcast(train(rows.filter("rule is not null"), sample))  # ``sample`` suffixes at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            free = x["verdict"].isna().to_numpy()
            part = x[free]
            blocked = model.value.score(part["url"].tolist(), part["host"].tolist(), part["path"].tolist()) > 0
            x.loc[free, "verdict"] = np.where(blocked, "block", "allow")
            yield x[["page_id", "host", "path", "rule", "verdict"]]

    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
