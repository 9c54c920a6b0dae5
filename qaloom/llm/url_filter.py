"""URL filters: rules by host and path first, then gradient-boosted trees on lexical features.

The trees are small and fitted on the driver from a bounded sample of labelled URLs; every page is
judged where it is read, without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and the
trees' verdict on its features; a URL is read whole, however long; repeated rows are judged one by
one; ids keep their 64 bits beside nulls; no rows give none; extra columns don't matter.

The labelled samples are made by rule, from coined names and from words that spammers are known
for.  None of them is taken from the tables that the registered query runs on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLES = 4_000  # labelled URLs that a model is fitted on, at most
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Words of hosts in the labelled samples: what people search for, and what spammers sell.
GOOD_WORDS = "news library garden school weather recipe travel museum science history music sport forum health market photo river city journal review".split()
BAD_WORDS = "loan replica viagra bonus jackpot hot deals clicks poker slots forex escort rx pharma lottery prize payday credit seo traffic backlinks weightloss".split()

SYLLABLES = "ba be bra co cre da del en er fi ga gen ha in is ka la lin ma men nor on or pa per ra re sa ser sh st ta th ti to tr un va ver wa wi zo".split()


def parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path)."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, prefix in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = prefix.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def labelled_urls(n: int = SAMPLES) -> tuple[list[str], np.ndarray]:
    """n URLs and whether each is to be blocked; the same ones each time."""
    urls, bad = [], []
    for i in range(n):
        d = hashlib.sha512(f"url:{i}".encode()).digest()
        pick = lambda k, of: of[int.from_bytes(d[2 * k : 2 * k + 2], "big") % len(of)]  # noqa: E731, B023
        wrong = i % 3 == 0
        coin = lambda k, least: "".join(pick(k + j, SYLLABLES) for j in range(least + d[k] % 3))  # noqa: E731, B023
        known = lambda k, words: pick(k, (coin(k + 16, 1), pick(k + 26, words)))  # noqa: E731, B023
        if wrong:
            name = known(0, BAD_WORDS) + pick(1, ("-", "-", "-", "")) + known(3, BAD_WORDS) + pick(15, ("", "", "", "24", "777", "-online"))
            tail = pick(8, ("", "", "/", ".html", "?id=7&aff=x&sub=1&clickid=9", "/go/out/" + d.hex()[:12], "#top"))
        else:
            name = pick(0, (coin(10, 2), coin(10, 2), pick(1, GOOD_WORDS))) + pick(2, ("", "", "", "", "", "", "-" + pick(3, GOOD_WORDS)))
            tail = pick(8, ("", "/", ".html", "?page=2&ref=x", "?lang=en", "#top"))
        host = pick(4, ("", "www.", "m.", "blog.")) + name + pick(5, ("", ".example")) + pick(6, (".com", ".org", ".net"))
        path = pick(7, ("/en/", "/fr/", "/de/", "/es/", "/", "/archive/2021/", "/a/")) + str(int.from_bytes(d[60:62], "big") % 1000) + tail
        urls.append(pick(9, ("http://", "https://")) + host + path)
        bad.append(wrong)
    return urls, np.array(bad)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _labels(host: str) -> list[str]:
    """The host's labels without the top one and the usual first ones."""
    out = [x for x in host.split(".") if x]
    return [x for x in out[:-1] if x not in ("www", "m", "blog", "example")] or out[:1]


def _suffixes(host: str) -> list[str]:
    """Endings that statistics are kept of: the top label, and of each own word its last 4 and 6 characters."""
    words = [w for x in _labels(host) for w in re.split(r"[-_]", x) if w]
    return ["." + host.rpartition(".")[2], *[f"{k}:{w[-k:]}" for w in words for k in (4, 6)]]


@dataclass
class UrlModel:
    """Suffix statistics (log-odds by ending), trees, and the split points of features."""

    odds: dict[str, float]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def features(self, urls: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(urls), 14))
        for i, url in enumerate(urls):
            rest = url.partition("://")[2]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0].lower()
            tail = rest[len(host) :]
            path, _, query = tail.partition("?")
            name = max(_labels(host), key=len, default="")
            seen = [self.odds.get(s, 0.0) for s in _suffixes(host)]
            digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
            out[i] = (
                len(url), len(host), len(path), path.count("/"), host.count("."), digits(url), digits(host), _entropy(url), _entropy(name),
                query.count("=") if query else 0, name.count("-"), len(name), max(seen, default=0), sum(seen) / max(1, len(seen)),
            )
        return out

    def score(self, urls: Sequence[str]) -> np.ndarray:
        """Log-odds that each URL is to be blocked."""
        x = self.features(urls)
        total = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total


def _grow(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of full depth by second-order gain; a node without a gain sends all to the left."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    gain = lambda g, h: g * g / (h + 1.0)
    for k in range(inner):
        here = node == k
        g, h = grad[here], hess[here]
        best = 1e-6
        for f, cuts in enumerate(bins):
            side = x[here, f][:, None] > cuts[None, :]
            gr, hr = g @ side, h @ side
            value = gain(gr, hr) + gain(g.sum() - gr, h.sum() - hr) - gain(g.sum(), h.sum())
            if len(cuts) and value.max() > best:
                best, feature[k], cut[k] = value.max(), f, cuts[value.argmax()]
        right = x[here, feature[k]] > cut[k]
        node[here] = 2 * k + 1 + right
    leaf = np.array([-grad[node == k].sum() / (hess[node == k].sum() + 1.0) * RATE for k in range(inner, 2 * inner + 1)])
    return feature, cut, leaf


def train(urls: Sequence[str], bad: np.ndarray, most: int = SAMPLES) -> UrlModel:
    """A model from at most ``most`` labelled URLs."""
    urls, bad = list(urls)[:most], np.asarray(bad, float)[:most]
    # Statistics of endings come from one half and trees from the other, which sees them as new.
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for url, y in list(zip(urls, bad, strict=True))[::2]:
        host = re.split(r"[/?#]", url.partition("://")[2], maxsplit=1)[0].lower()
        for s in set(_suffixes(host)):
            seen[s][int(y)] += 1
    share = bad[::2].mean()
    odds = {s: math.log((b + share) / (g + 1 - share)) - math.log(share / (1 - share)) for s, (g, b) in seen.items() if g + b >= 3}
    model = UrlModel(odds, math.log(bad.mean() / (1 - bad.mean())), [])
    x, y = model.features(urls[1::2]), bad[1::2]
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    total = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        feature, cut, leaf = tree = _grow(x, bins, p - y, p * (1 - p))
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        total += leaf[node - (2**DEPTH - 1)]
        model.trees.append(tree)
    return model


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """One row per row: id, host, path, rule, block_score (the trees' log-odds) and verdict (allow or block)."""
    model = model or train(*labelled_urls())
    kind = dict(df.dtypes)[id_col]
    host, path = parts(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score([u or "" for u in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["id", "url", "block_score"])

    scored = rows.mapInArrow(score, f"id {kind}, url string, block_score double")
    out = scored.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": said})
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "block_score", F.coalesce("said", F.when(F.col("block_score") > 0, "block").otherwise("allow")).alias("verdict"))
