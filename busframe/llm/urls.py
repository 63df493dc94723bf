"""URL filter: block and allow rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled table of URLs (at most `max_labelled` rows, a parameter) and
is a vector of 2**bits weights, so scoring needs no shuffle; only the url column is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import mix

#: (rule, verdict): host, then the start of the path after its first slash.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

#: General words of unwanted and of ordinary sites and paths (fixed word lists).
UNWANTED = "casino poker bingo jackpot roulette lottery betting slots gamble viagra cialis pharmacy pills weightloss porn xxx adult erotic escort webcam nude warez torrent crack keygen phishing spam clickbait adserver adclick tracker popup banner malware hack payday loan cheap free win bonus replica"
ORDINARY = "news blog docs wiki library university science history garden recipes travel weather museum school sports music forum support city health council research shop store market press journal review guide photo video book film art design studio office bank law tax energy water forest farmers river mountain island coast harbour station airport hotel restaurant coffee bakery kitchen family children parents teacher student doctor hospital clinic engine motor bicycle railway bridge theatre gallery church festival community project software data network cloud mobile map calendar mail account help"
TAILS = "ster ton land hub point world line works lab net berg ville ing ers een"
SECTIONS = "about contact index article story page item archive category tag post view list search product"


def labelled_urls(most: int = 2000, unwanted: str = UNWANTED, ordinary: str = ORDINARY) -> list[tuple[str, int]]:
    """A small labelled table made of the words by rule: hosts of one or two words, or of a word and a tail; half of the
    ordinary ones are random letters, as a name that says nothing is no reason to block. Paths say nothing about the
    label. `most` unwanted ones, three times as many ordinary ones."""
    rng = np.random.default_rng(5)
    bad, good, tails, sections = unwanted.split(), ordinary.split(), TAILS.split(), SECTIONS.split()
    pick = lambda words: words[rng.integers(len(words))]
    out = []
    for label, words in ((1, bad), (0, good)):
        for i in range(most if label else 3 * most):
            word = words[i % len(words)] if label or i % 2 else "".join(pick(list("etaoinshrdlucmfwypvbgk")) for _ in range(rng.integers(3, 10)))
            other = pick(bad if label and rng.random() < 0.5 else good)
            host = (f"{word}-{other}", f"{word}{other}", f"{other}-{word}", f"{word}{rng.integers(1, 1000)}", f"{word}{pick(tails)}", word)[rng.integers(6)]
            front = pick(["", "", "www.", "m.", f"{pick(good)}."])
            path = pick(["", f"{pick(sections)}/{rng.integers(1, 10_000)}", f"{pick(good)}/{pick(sections)}.html", f"{pick(['en', 'de', 'fr', 'es'])}/{rng.integers(1, 10_000)}"])
            out.append((f"https://{front}{host}.{pick(['com', 'net', 'org', 'info', 'de', 'fr'])}/{path}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end.
    Both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def grams(hosts: Sequence[str], paths: Sequence[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (3 to 5 bytes) of many hosts and paths, with marks at their ends: row and place of each, one entry
    for each distinct one of a row. All n-grams of a batch are hashed together."""
    rows, places = [], []
    for kind, texts in enumerate((hosts, paths)):
        parts = [f"^{t}$".encode() for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        size = np.array([len(p) for p in parts], np.int64)
        row = np.repeat(np.arange(len(parts)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes up to the end of the text
        h = data + np.uint64(1)
        for n in range(2, 6):
            h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1) if len(h) else h
            if n >= 3:
                inside = left[: len(h)] >= n
                rows.append(row[: len(h)][inside])
                places.append(mix(h[inside] + np.uint64(kind << 60)) & np.uint64((1 << bits) - 1))
    both = np.unique(np.concatenate(rows).astype(np.int64) << bits | np.concatenate(places).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability that each URL is unwanted."""
        n = len(hosts)
        row, place = grams(hosts, paths, self.bits)
        size = np.maximum(1, np.bincount(row, minlength=n))
        return 1 / (1 + np.exp(-(np.bincount(row, self.weights[place], n) / np.sqrt(size) + self.bias)))


def train(rows: list[tuple[str, str, int]], *, bits: int = 16, rounds: int = 200, penalty: float = 1e-3, rate: float = 2.0) -> UrlModel:
    """Logistic regression by gradient descent over (host, path, label 1 = unwanted)."""
    n = len(rows)
    y = np.array([r[2] for r in rows], float)
    row, column = grams([r[0] for r in rows], [r[1] for r in rows], bits) if n else (np.zeros(0, np.int64),) * 2
    value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[row]
    weights, bias = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[column] * value, n) + bias)))
        error = (p - y) / max(1, n)
        weights -= rate * (np.bincount(column, error[row] * value, 1 << bits) + penalty * weights / max(1, n)) * 10
        bias -= rate * error.sum()
    return UrlModel(weights, bias, bits)


def train_urls(labelled: DataFrame, *, max_labelled: int = 20_000, bits: int = 16) -> UrlModel:
    """The model of a small table (url, label): at most max_labelled of its rows reach the driver."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("label is not null").select(host, path, "label").limit(max_labelled).collect()
    return train([tuple(r) for r in rows], bits=bits)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits the host or a parent domain and starts the path."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def filter_urls(pages: DataFrame, model: UrlModel, *, key: str = "page_id", rules: list[tuple[str, str]] = RULES, limit: float = 0.5) -> DataFrame:
    """Key, host, path, rule, verdict and score (null where a rule decides) of every row. Null, empty or malformed URLs have an empty host and path
    and are judged by the model like any other."""

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, host.index)
        open_ = host.notna()
        if open_.any():
            out[open_] = model.scores(host[open_].tolist(), path[open_].tolist())
        return out

    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("given"))
    scored = ruled.withColumn("score", score(F.when(F.col("given").isNull(), F.col("host")), F.col("path")))  # only where no rule decides
    return scored.select(key, "host", "path", "rule", F.coalesce("given", F.when(F.col("score") >= limit, "block").otherwise("allow")).alias("verdict"), F.nanvl("score", F.lit(None)).alias("score"))
