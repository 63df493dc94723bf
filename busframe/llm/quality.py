"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; a table of labels, where there is one, is
one more labeller. Expectation-maximisation over the counts of vote patterns (all documents, a few hundred patterns)
estimates each labeller's accuracy and the share of good documents; the posterior of each pattern then labels a bounded
sample of documents, on which a linear scorer over hashed features is trained. The scorer judges every document where
it is read. Two tasks are fitted this way, writing quality and toxicity; a document is rejected if either scorer says so.

Toxicity has no word list of its own. A bounded sample of labelled documents is dealt into three folds, and three lists
of words that are frequent in toxic documents and rare in clean ones are mined, each without one of the folds. The lists
are three overlapping labellers that work in every language the labels cover; a labelled document gets the vote of the
one list that was mined without it. These documents also train the toxicity scorer.

Scale: two scans of the texts, and one for each sample; only votes are joined (with the labels) and counted. Words are
counted by a shuffle, and features are made where the texts are read. The samples are bounded in documents by
`max_sample` and in features of each document by `max_features`, both parameters; each scorer is trained on its sample
in one executor's task, and only its weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import gram_hashes, hash_words, mix, written

#: Function words of four languages (a fixed word list); compared without upper case in A-Z.
COMMON = "the of and to in a is that it was for on are as with his they be at this der die das und ein eine zu den von mit für ist nicht le la les de des et un une est que dans pour qui el los las y en por con para"

#: Labellers of each task, in the order of the votes. 1 good, 0 bad, -1 no vote.
QUALITY = ("symbols", "capitals", "stutter", "repeats", "function_words", "odd_endings", "whole", "labels")
FOLDS = 3
TOXICITY = (*(f"words without fold {k}" for k in range(FOLDS)), "labels")
BUCKETS = 16
#: Documents whose features are held at once.
PIECE = 256
_ASCII = np.arange(256)
_UPPER, _LOWER = (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122)
_ODD = (_ASCII > 32) & (_ASCII < 127) & ~_UPPER & ~_LOWER & ~np.isin(_ASCII, np.frombuffer(b".,;:'\"-()?0123456789", np.uint8))


def _known(words: str) -> np.ndarray:
    return np.sort(np.concatenate([hash_words(w.encode())[0] for w in words.split()]))


#: A-Z to lower case, marks to blanks.
_FOLD = bytes(ord(" ") if chr(i) in ".,;:!?\"'()*#$%&|" else i + 32 if _UPPER[i] else i for i in range(256))
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(6)], np.uint64)


def _member(words: str):
    """A function from word hashes to the number of them that are in a list; a slot holds one of its hashes."""
    slots = np.zeros(1 << 18, np.uint64)
    known = _known(words)
    slots[known & np.uint64(0x3FFFF)] = known
    assert len(np.unique(known & np.uint64(0x3FFFF))) == len(np.unique(known))
    return lambda hashes: int((slots[hashes & np.uint64(0x3FFFF)] == hashes).sum())


_common = _member(COMMON)


@dataclass
class Traits:
    """What the labellers and the scorer look at."""

    shares: dict[str, float]
    words: np.ndarray  # hashes of lower-case words without marks at their ends
    starts: np.ndarray  # first five bytes of these words, as numbers


def traits(text: str | None) -> Traits:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    words, starts, ends = hash_words(raw)
    folded = raw.translate(_FOLD)
    plain, at, end = hash_words(folded)
    eight = np.ndarray(len(folded) + 1, "<u8", folded + b"        ", strides=(1,))  # the eight bytes from each place
    front = eight[at] & _FIRST[np.minimum(end - at, 5)] if len(at) else plain
    upper, lower = int(_UPPER[data].sum()), int(_LOWER[data].sum())
    n = max(1, len(words))
    grams = gram_hashes(words, 5)
    last = data[ends - 1] if len(words) else data[:0]
    shares = {
        "symbols": float(_ODD[data].sum()) / max(1, len(data)),
        "capitals": upper / max(1, upper + lower),
        "stutter": float((words[1:] == words[:-1]).sum()) / n,
        "repeats": 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0,
        "function_words": _common(plain) / n,
        "odd_endings": float(_ODD[last].sum()) / n,
    }
    return Traits(shares, plain, front)


#: Share from which a labeller says bad, and share up to which it says good (function words: the other way round).
BOUNDS = {"symbols": (0.06, 0.03), "capitals": (0.5, 0.2), "stutter": (0.15, 0.05), "repeats": (0.5, 0.25), "function_words": (0.02, 0.06), "odd_endings": (0.3, 0.1)}


@dataclass
class WordList:
    """Words that mark toxic documents, by their sorted hashes, and how much each counts."""

    words: np.ndarray
    weight: np.ndarray

    def level(self, words: np.ndarray) -> int:
        """Weight of the distinct listed words of a text, at most 4; 0 below 2, or below one in 100 of its words."""
        if not len(self.words):
            return 0
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = np.unique(at[self.words[at] == words])
        n = int(self.weight[hit].sum())
        return min(4, n) if n >= 2 and len(hit) >= 0.01 * len(words) else 0


def joint_level(lists: list[WordList], words: np.ndarray) -> int:
    """The middle one of the lists' levels."""
    return sorted(m.level(words) for m in lists)[len(lists) // 2]


def mined_lists(told: DataFrame, *, ratio: float = 8.0, evidence: float = 6.0, sure: float = 15.0) -> list[WordList]:
    """A list for each fold, of the words of the documents outside it: those whose share of the toxic documents is at least
    `ratio` times that of the clean ones, and whose number of toxic documents is unlikely at the clean ones' rate: the
    logarithm of the Poisson likelihood ratio is at least `evidence`. Words that reach `sure` count twice. told:
    (fold, fine, words) of labelled documents, words distinct."""
    part = [(k, fine) for k in range(FOLDS) for fine in (0, 1)]
    count = lambda k, fine: F.count(F.when((F.col("fold") == k) & (F.col("fine") == fine), 1))
    totals = told.agg(*[count(k, fine) for k, fine in part]).first()
    n = {x: totals[i] for i, x in enumerate(part)}
    words = told.select("fold", "fine", F.explode("words").alias("word")).groupBy("word").agg(*[count(k, fine).alias(f"n{k}{fine}") for k, fine in part])
    tests = []
    for k in range(FOLDS):
        rest = [j for j in range(FOLDS) if j != k]
        bad, good = (sum(F.col(f"n{j}{fine}") for j in rest) for fine in (0, 1))
        expected = (good + 0.5) / (sum(n[j, 1] for j in rest) + 1) * (sum(n[j, 0] for j in rest) + 1)
        odds = (bad + 0.5) / expected
        proof = bad * F.log(odds) - (bad - expected)
        tests.append(F.when((odds < ratio) | (proof < evidence), 0).when(proof < sure, 1).otherwise(2).alias(f"w{k}"))
    # words that mark toxic documents of the bounded sample
    rows = words.select("word", *tests).filter(" + ".join(f"w{k}" for k in range(FOLDS)) + " > 0").toPandas()
    hashes = rows.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    out = []
    for k in range(FOLDS):
        weight = rows[f"w{k}"].to_numpy(np.int64)[order]
        out.append(WordList(hashes[order][weight > 0], weight[weight > 0]))
    return out


def votes(t: Traits, lists: list[WordList]) -> tuple[list[int], list[int]]:
    """Votes on quality and toxicity, without those of the labels. The first labellers only say bad or nothing, the last
    one judges the whole. Texts of under 8 words are judged by their marks alone."""
    worse = {name: (x - BOUNDS[name][0]) * (BOUNDS[name][0] - BOUNDS[name][1]) >= 0 for name, x in t.shares.items()}
    fine = {name: (x - BOUNDS[name][1]) * (BOUNDS[name][0] - BOUNDS[name][1]) <= 0 for name, x in t.shares.items()}
    seen = QUALITY[:-2] if len(t.words) >= 8 else ("symbols", "odd_endings")
    quality = [0 if name in seen and worse[name] else -1 for name in QUALITY[:-2]]
    whole = 0 if 0 in quality and not fine["function_words"] else 1 if all(fine[name] for name in seen) else -1
    return [*quality, whole], [0 if marks.level(t.words) else -1 for marks in lists]


@dataclass
class LabelModel:
    """Share of good documents, and each labeller's chances of its three votes (nothing, bad, good) on a good and on a
    bad document. The last column of the patterns holds given labels, which are right 99 times in 100."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        own, given = patterns[:, :-1] + 1, patterns[:, -1]
        log = lambda p: np.log(p)[np.arange(own.shape[1]), own].sum(1)
        a, b = np.log(self.prior) + log(self.good), np.log(1 - self.prior) + log(self.bad)
        return np.where(given == 1, 0.99, np.where(given == 0, 0.01, 1 / (1 + np.exp(np.clip(b - a, -50, 50)))))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 100, prior: float = 0.85) -> LabelModel:
    """Expectation-maximisation. At the start every labeller is taken to find a third of its class and to be wrong one
    time in 50; without documents that is the result."""
    m = patterns.shape[1] - 1
    model = LabelModel(prior, np.tile([0.65, 0.02, 0.33], (m, 1)), np.tile([0.65, 0.33, 0.02], (m, 1)))
    if not counts.sum():
        return model
    cast = np.stack([patterns[:, :-1] == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        p = model.posterior(patterns)
        rate = lambda w: (np.einsum("k,kmv->mv", w, cast) + [0.5, 0.01, 0.01]) / (w.sum() + 0.52)
        new = LabelModel(float(np.clip(counts @ p / counts.sum(), 0.01, 0.99)), rate(counts * p), rate(counts * (1 - p)))
        done = np.abs(new.good - model.good).max() + np.abs(new.bad - model.bad).max() < 1e-6
        model = new
        if done:
            break
    return model


def hashed_features(t: Traits, bits: int) -> np.ndarray:
    """Places of the features that a document has: its words and their starts, and its shares in buckets."""
    marks = [mix(np.array([i * 1000 + min(BUCKETS - 1, int(x * BUCKETS * 2))], np.uint64)) for i, x in enumerate(t.shares.values(), 1)]
    return np.unique(np.concatenate([t.words, mix(t.starts + np.uint64(1)), *marks]) & np.uint64((1 << bits) - 1)).astype(np.int32)


def with_marks(features: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The features of the toxicity scorer: those of a document and its level in the word lists."""
    return np.union1d(features, (mix(np.array([95_000 + level], np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int32))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    bits: int

    def __call__(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum() + self.bias, -30, 30))))


def fit_scorer(column: np.ndarray, sizes: np.ndarray, target: np.ndarray, bits: int, *, rounds: int = 150, penalty: float = 1e-3) -> Scorer:
    """Logistic regression on soft labels, by Adam over the whole sample. Its classes keep their shares, so that a clean
    document is rarely rejected for a word. column: the features of all documents, sizes:
    how many each has, at least one."""
    n = len(sizes)
    if not n:
        return Scorer(np.zeros(1 << bits, np.float32), 5.0, bits)
    # entries by document, and by feature: both sums run over neighbours
    order = np.argsort(column, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    column = column[order]
    new = np.concatenate(([True], column[1:] != column[:-1]))
    used, first = column[new], np.flatnonzero(new)
    del column
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order, new
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    w, bias = np.zeros(len(used), np.float32), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[back], begin) + bias, -30, 30)))
        error = ((p - target) / n).astype(np.float32)
        g = np.append(np.add.reduceat(error[row], first) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 / (1 + i / 10) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)
        w -= step[:-1].astype(np.float32)
        bias -= step[-1]
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    return Scorer(weights, bias, bits)


@dataclass
class QualityModel:
    quality: Scorer
    clean: Scorer
    quality_labels: LabelModel
    clean_labels: LabelModel
    lists: list[WordList]

    def column(self, text: Column) -> Column:
        """struct(quality, clean): probability that the writing is good, and that the text isn't toxic. A text without
        words has quality 0."""
        quality, clean, lists = self.quality, self.clean, self.lists

        @F.pandas_udf("quality double, clean double")
        def score(texts: pd.Series) -> pd.DataFrame:
            out = []
            for text in texts:
                t = traits(text)
                f = hashed_features(t, quality.bits)
                level = joint_level(lists, t.words)
                out.append((quality(f) if len(t.words) else 0.0, clean(with_marks(f, level, clean.bits))))
            return pd.DataFrame(out, columns=["quality", "clean"], dtype=float)

        return score(text)


def _sampled_features(rows: DataFrame, task: str, lists: list[WordList], model: LabelModel, bits: int, most: int) -> DataFrame:
    """(task, sizes, columns, targets): the features and the target of many documents in each row, as int and double
    arrays in bytes. rows: (text, pattern, fold), fold -1 where all lists count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (batch[at : at + PIECE] for batch in batches for at in range(0, len(batch), PIECE)):
            features = []
            for text, fold in zip(b.text, b.fold, strict=True):
                t = traits(text)
                f = hashed_features(t, bits)
                if task == "clean":
                    f = with_marks(f, joint_level([m for i, m in enumerate(lists) if fold in (-1, i)], t.words), bits)
                features.append(f[:most])
            target = model.posterior(np.array(b.pattern.tolist(), int))
            sizes = np.array([len(f) for f in features], np.int32)
            yield pd.DataFrame({"task": [task], "sizes": [sizes.tobytes()], "columns": [np.concatenate(features).astype(np.int32).tobytes()], "targets": [target.astype(float).tobytes()]})

    return rows.select("text", "pattern", "fold").mapInPandas(run, "task string, sizes binary, columns binary, targets binary")


def fit(docs: DataFrame, labels: DataFrame | None = None, *, max_sample: int = 8000, max_features: int = 1 << 12, bits: int = 18) -> QualityModel:
    """labels: (doc_id, quality, toxic), for any part of the documents; nulls don't vote; of repeated ids the smallest
    values count. Each scorer is trained on at most max_sample documents, chosen by a hash of their id and text; for
    toxicity, at most max_sample labelled ones, chosen by a hash of their id, are added, from which the word lists come.
    A document of the samples gives at most max_features features, so a scorer's task holds at most 2 * max_sample *
    max_features numbers of four bytes, and its training five times as many."""
    spark = docs.sparkSession
    ship_package(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    if labels is None:
        given = lambda df: df.select("*", F.lit(-1).alias("good"), F.lit(-1).alias("fine"))
        told = spark.createDataFrame([], "text string, fine int, doc_id long")
    else:
        known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"), (1 - F.max("toxic")).cast("int").alias("fine"))
        given = lambda df: df.join(known, "doc_id", "left").fillna(-1, ["good", "fine"])
        here = known.filter("fine is not null").join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "fine")
        picked = written(here.orderBy(F.xxhash64(F.lit("labelled"), "doc_id"), "doc_id").limit(max_sample), "picked")
        # at most max_sample rows are broadcast; copies of a text count once
        told = ids.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.min("fine").alias("fine"), F.min("doc_id").alias("doc_id"))
        told = told.orderBy(F.xxhash64(F.lit("labelled"), "text"), "doc_id").limit(max_sample)
    told = written(told.withColumn("fold", fold), "labelled")

    @F.pandas_udf("array<long>")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(traits(text).words).view(np.int64) for text in texts])

    lists = mined_lists(told.select("fold", "fine", distinct_words("text").alias("words")))

    @F.pandas_udf("q array<int>, t array<int>")
    def vote(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([votes(traits(text), lists) for text in texts], columns=["q", "t"])

    own = lambda df: df.withColumn("v", vote("text"))
    # the list that a labelled document is part of has no vote on it
    apart = F.transform("v.t", lambda x, i: F.when((F.col("fine") < 0) | (i == fold), x).otherwise(-1))
    q_pattern, t_pattern = F.concat("v.q", F.array("good")), F.concat(apart, F.array("fine"))
    all_votes = given(own(ids).select("doc_id", "v"))
    # a row per pattern: at most 3 to the power of the labellers, however many documents
    rows = all_votes.groupBy(q_pattern.alias("q"), t_pattern.alias("t")).count().collect()
    counts = np.array([r["count"] for r in rows], float)
    table = lambda k, m: np.array([r[k] for r in rows], int).reshape(-1, m)
    quality, clean = fit_labels(table("q", len(QUALITY)), counts), fit_labels(table("t", len(TOXICITY)), counts)

    n = counts.sum()
    dice = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = given(own(ids.filter(dice < 0.9 * max_sample / max(n, 1)).orderBy(dice, "doc_id").limit(max_sample)))
    sample = written(sample.select("text", "fine", q_pattern.alias("q"), t_pattern.alias("t")), "sample")
    none = F.lit(-1)
    labelled = told.select("text", F.array(*[none] * FOLDS, F.col("fine")).alias("pattern"), "fold")
    parts = [
        _sampled_features(sample.select("text", F.col("q").alias("pattern"), none.alias("fold")), "quality", lists, quality, bits, max_features),
        _sampled_features(sample.filter("fine < 0").select("text", F.col("t").alias("pattern"), none.alias("fold")), "clean", lists, clean, bits, max_features),
        _sampled_features(labelled, "clean", lists, clean, bits, max_features),
    ]

    def train(chunk: pd.DataFrame) -> pd.DataFrame:
        task = chunk.task.iloc[0]
        # what is read is let go before the training: only the training's own numbers are held
        made = fit_scorer(*[np.concatenate([np.frombuffer(x, kind) for x in chunk.pop(c)]) for c, kind in (("columns", np.int32), ("sizes", np.int32), ("targets", float))], bits)
        return pd.DataFrame({"task": [task], "weights": [made.weights.astype(np.float32).tobytes()], "bias": [made.bias]})

    fitted = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("task").applyInPandas(train, "task string, weights binary, bias double").collect()  # two rows
    empty = fit_scorer(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), bits)
    scorers = {r.task: Scorer(np.frombuffer(r.weights, np.float32), r.bias, bits) for r in fitted}
    return QualityModel(scorers.get("quality", empty), scorers.get("clean", empty), quality, clean, lists)


def classify(docs: DataFrame, model: QualityModel, *, limit: float = 0.5) -> DataFrame:
    """doc_id, quality, clean, verdict (keep or reject) of every row. Null and empty texts, and those without words, are
    rejected. Repeated rows have equal results."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), model.column(F.col("text")).alias("s"))
    keep = (F.col("s.quality") >= limit) & (F.col("s.clean") >= limit)
    return scored.select("doc_id", "s.quality", "s.clean", F.when(keep, "keep").otherwise("reject").alias("verdict"))
