"""Substring dedup by prefix-partitioned suffix trees over words.

A word goes if it lies in a window of `window` consecutive words that also starts anywhere else in the corpus. Suffixes
that can't begin such a window are never sorted:

1. Synchronised prefixes. Of every window the smallest hash of its `gram`-word n-grams is its prefix's place, so equal
   windows have equal prefixes at equal places. About 2 in `window - gram` words start such a prefix. Prefixes that
   occur once have trivial subtrees and are dropped.
2. Variable-length prefixes. A prefix with at most `hot` places is one subtree, and subtrees are dealt out in groups that
   fit in memory. A longer list of places is split: the windows that a prefix stands for (they begin 0 to
   window - gram words before it) are halved by where they begin, and what the windows of one half have in common is a
   longer prefix. That goes on, to one window and a prefix as long as the window if need be. On the way, places that
   agree in all words of their windows are settled at once by their count, and one of them goes on for all; prefixes
   that are left with one place are dropped. Only hashes and places move here, and counts are combined before they do.
3. In a group, suffixes are sorted by their words and the longest common prefix of each with the one before is taken. A
   run of suffixes that agree to a depth d is an internal node of the subtree; with the words before them, leaves of a
   node of depth window - l that also agree in l words to the left begin the same window: a repeat, which is extended
   as far to the left and right as it goes.

Equal texts are handled once: of a text that has copies and a window, all words go. Texts move three times: to their
prefixes' places, and to their repeats; nothing but texts, places, hashes and counts is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import gram_hashes, hash_words, mix, written

GROUP_SLICES = 20_000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def synchronised(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams that are the smallest of some window."""
    grams = gram_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), grams[:0]
    low = sliding_min(grams, span)
    edge = np.zeros(span - 1, np.uint64)
    best = ~sliding_min(~np.concatenate([edge, low, edge]), span)  # largest of the minima of all windows around
    at = np.flatnonzero(best == grams)
    return at, grams[at]


def common_prefixes(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of word numbers), and the words that each shares with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}")[:, 0], kind="stable")
    words, length = words[order], length[order]
    differ = words[1:] != words[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    return order, np.concatenate(([0], np.minimum(shared, np.minimum(length[1:], length[:-1]))))


def repeated_windows(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, window: int) -> np.ndarray:
    """Whether the window that begins l words before each prefix is repeated, in column l.

    right: the words from each prefix on; left: those before it, nearest first; n_left, n_right: how many there are."""
    order, shared = common_prefixes(right, n_right)
    left, n_left, n_right = left[order], n_left[order], n_right[order]
    out = np.zeros((len(order), left.shape[1] + 1), bool)
    before = np.zeros(len(order), np.uint64)
    for back in range(left.shape[1] + 1):
        if back:
            before = mix(before * np.uint64(0x9E3779B97F4A7C15) + left[:, back - 1])
        depth = window - back
        node = np.cumsum(shared < depth)
        whole = (n_left >= back) & (n_right >= depth)
        leaves = np.bincount(node[whole], minlength=node[-1] + 1)
        at = np.flatnonzero(whole & (leaves[node] > 1))
        if len(at) > 1:
            both = mix(before[at] + mix(node[at].astype(np.uint64)))
            _, index, count = np.unique(both, return_inverse=True, return_counts=True)
            out[at, back] = count[index] > 1
    undo = np.empty_like(order)
    undo[order] = np.arange(len(order))
    return out[undo]


def lead_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def halves(n: int) -> list[tuple[int, int]]:
    """The ranges (first, number) of a binary tree over n windows, every range before its left and then its right half."""

    def below(first: int, n: int) -> list[tuple[int, int]]:
        h = (n + 1) // 2
        return [(first, n)] + (below(first, h) + below(first + h, n - h) if n > 1 else [])

    return below(0, n)


def hash_ranges(words: np.ndarray, place: np.ndarray, window: int, span: int) -> np.ndarray:
    """For each place and each range of the tree over its windows: a hash of what the windows of the range have in
    common, which for a range of one is the window. 0 where no window of the range lies within the text."""
    base = 0x9E3779B97F4A7C15
    powers = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words), np.uint64(x), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(base)[:-1], dtype=np.uint64)))
    down, common = powers(pow(base, -1, 1 << 64)), []
    for first, n in halves(span):
        lo, hi = np.maximum(first, window - len(words) + place), np.minimum(first + n - 1, place)  # windows within the text
        begin, end = (np.clip(np.where(lo <= hi, x, 0), 0, len(words)) for x in (place - first, place - first - n + 1 + window))
        common.append(np.where(lo <= hi, mix((sums[end] - sums[begin]) * down[begin]) + np.uint64(first * 1000 + n), 0))
    return np.stack(common, 1)


def split_hot(places: DataFrame, window: int, span: int) -> DataFrame:
    """(h1, h2, a, b): ranges of words covered by repeated windows around places (h1, h2, place, lo, hi, common), by
    prefixes that grow until each has one place, or one content. lo, hi: the windows that lie within the text; common:
    `hash_ranges`. Rows may repeat."""
    size = F.array(*[F.lit(len(halves(n))) for n in range(1, span + 1)])
    single = F.array(*[F.array(*[F.lit(i) for i, (_, m) in enumerate(halves(n)) if m == 1]) for n in range(1, span + 1)])
    spot = ["h1", "h2", "place", "first"]
    low, high = F.greatest("first", "lo"), F.least(F.col("first") + F.col("n") - 1, F.col("hi"))
    # all windows of a range together: what makes places of one prefix equal
    whole = F.xxhash64(F.transform(F.element_at(single, F.col("n")), lambda i: F.get("common", i)), low - F.col("first"), high - F.col("first"))
    rows = written(places.withColumn("first", F.lit(0)).withColumn("n", F.lit(span)), "hot-places")
    found = []
    while not rows.isEmpty():  # at most log2(span) + 2 times
        rows = rows.withColumn("c", F.col("common")[0]).withColumn("w", whole)
        classes = written(rows.groupBy("c", "w").agg(F.min(F.struct(*spot)).alias("one"), F.max(F.struct(*spot)).alias("other")), "hot-contents")
        again = classes.filter("one <> other").select("c", "w")
        settled = rows.join(again, ["c", "w"]).select("h1", "h2", (F.col("place") - high).alias("a"), (F.col("place") - low + window).alias("b"))
        found.append(written(settled, "hot-repeats"))
        several = written(classes.groupBy("c").count().filter("count > 1").select("c"), "hot-prefixes")
        on = rows.filter("n > 1").join(classes.join(several, "c").select("one.*"), spot)
        h = F.ceil(F.col("n") / 2).cast("int")
        child = lambda first, n, at: F.struct(first.alias("first"), n.alias("n"), F.slice("common", at, F.element_at(size, n)).alias("common"))
        pair = F.array(child(F.col("first"), h, F.lit(2)), child(F.col("first") + h, F.col("n") - h, F.element_at(size, h) + 2))
        rows = written(on.select("h1", "h2", "place", "lo", "hi", F.explode(pair).alias("x")).select("h1", "h2", "place", "lo", "hi", "x.*").filter("common[0] <> 0"), "hot-places")
    return reduce(DataFrame.unionByName, found) if found else rows.select("h1", "h2", F.lit(0).alias("a"), F.lit(0).alias("b"))


def dedup_substrings(docs: DataFrame, *, window: int = 35, gram: int = 10, hot: int = GROUP_SLICES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null, empty and blank texts have no words and the hash of an empty text. Repeated rows are copies of each other.
    Texts with fewer words than a window lose none."""
    ship_package(docs.sparkSession)
    span = window - gram + 1
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h1"), F.hash(body).alias("h2"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            rows, places, keys = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, key = synchronised(hash_words(text.encode())[0], window, gram)
                rows.append(np.full(len(at), i))
                places.append(at)
                keys.append(key)
            if rows:
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[row]), pa.array(h2[row]), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))],
                    names=["h1", "h2", "place", "key"],
                )

    copies = written(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies")), "copies")
    places = written(rows.select("h1", "h2", "text").mapInArrow(prefixes, "h1 long, h2 int, place int, key long"), "prefixes")
    spot = F.xxhash64("h1", "h2", "place")
    often = places.groupBy("key").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count("*").alias("n")).filter("a <> b").select("key", "n")
    often = written(often, "repeated-prefixes")
    total = often.agg(F.sum(F.when(F.col("n") <= hot, F.col("n")))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP_SLICES))
    marks = places.join(often, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("place", "key", (F.col("n") > hot).alias("hot"))).alias("marks"))
    one = copies.withColumn("one", F.coalesce("one", F.lit(-(1 << 62))))
    keyed = rows.withColumn("one", F.coalesce("doc_id", F.lit(-(1 << 62)))).select("h1", "h2", "one", "text").repartition("h1", "h2", "one")
    marked = keyed.join(marks.join(one, ["h1", "h2"]).select("h1", "h2", "one", "marks"), ["h1", "h2", "one"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words around each prefix, or for those with many places the hashes of the ranges of their windows."""
        for batch in batches:
            begin = batch.column("marks").offsets.to_numpy()
            flat = batch.column("marks").flatten()
            place, key, is_hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            owner, starts_at, leads, words_in, groups, hot_rows = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                mine = slice(begin[i] - begin[0], begin[i + 1] - begin[0])
                data = text.encode()
                words, starts, ends = hash_words(data)
                at = place[mine][~is_hot[mine]].astype(np.int64)
                if len(at):
                    lead = np.minimum(span - 1, at)
                    froms, tos = starts[at - lead].tolist(), ends[np.minimum(len(ends), at + window) - 1].tolist()
                    owner.append(np.full(len(at), i))
                    starts_at.append(at - lead)
                    leads.append(lead)
                    groups.append(key[mine][~is_hot[mine]] % n_groups)
                    words_in += [data[a:b] for a, b in zip(froms, tos, strict=True)]
                at = place[mine][is_hot[mine]].astype(np.int64)
                if len(at):
                    hot_rows.append((np.full(len(at), i), at, np.maximum(0, window - len(words) + at), np.minimum(span - 1, at), hash_ranges(words, at, window, span)))
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            none = lambda n, kind: pa.nulls(n, kind)
            if owner:
                i, n = np.concatenate(owner), len(words_in)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[i]), pa.array(h2[i]), pa.array(np.concatenate(groups)), pa.array(np.concatenate(starts_at).astype(np.int32)), pa.array(np.concatenate(leads).astype(np.int32)), pa.array(words_in, pa.binary()),
                     none(n, pa.int32()), none(n, pa.int32()), none(n, pa.list_(pa.int64()))], names=names,
                )
            if hot_rows:
                i, at, lo, hi, common = (np.concatenate(c) for c in zip(*hot_rows, strict=True))
                n = len(i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * common.shape[1]), pa.array(common.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[i]), pa.array(h2[i]), none(n, pa.int64()), pa.array(at.astype(np.int32)), none(n, pa.int32()), none(n, pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), lists], names=names,
                )

    names = ["h1", "h2", "grp", "start", "lead", "words", "lo", "hi", "common"]
    slices = marked.select("h1", "h2", "text", "marks").mapInArrow(around, "h1 long, h2 int, grp long, start int, lead int, words binary, lo int, hi int, common array<long>")
    slices = written(slices, "suffixes")

    def subtree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["h1", "h2", "start", "lead"])
        lead, start = group.lead.to_numpy(np.int64), group.start.to_numpy(np.int64)
        hashes, at, _ = hash_words(b"\n".join(group.words))
        ends = np.cumsum(np.array([len(w) + 1 for w in group.words]))
        row = np.searchsorted(ends, at, "right")
        n = np.bincount(row, minlength=len(group))
        column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) - lead[row]  # 0 where the prefix begins
        words = np.zeros((len(group), span - 1 + window), np.uint64)
        words[row, column + span - 1] = hashes
        found = repeated_windows(words[:, : span - 1][:, ::-1], words[:, span - 1 :], lead, n - lead, window)
        row, low, high = lead_runs(found)
        place = (start + lead)[row]
        return pd.DataFrame({"h1": group.h1.to_numpy()[row], "h2": group.h2.to_numpy()[row], "a": place - high, "b": place - low + window})

    cold = slices.filter("grp is not null").select("h1", "h2", "grp", "start", "lead", "words").groupBy("grp").applyInPandas(subtree, "h1 long, h2 int, a int, b int")
    warm = split_hot(slices.filter("grp is null").select("h1", "h2", F.col("start").alias("place"), "lo", "hi", "common"), window, span)
    gone = cold.unionByName(warm).groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h1, h2, text, copies, gone in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text", "copies", "gone")), strict=True):
                words = text.encode().split()
                keep = np.ones(len(words), bool)
                if copies > 1 and len(words) >= window:
                    keep[:] = False
                for r in gone or ():
                    keep[r["a"] : r["b"]] = False
                kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                out.append((h1, h2, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h1", "h2", "n_words", "n_removed", "kept_sha256"])

    fates = one.join(gone, ["h1", "h2"], "left")
    last = keyed.join(fates, ["h1", "h2", "one"]).select("h1", "h2", "text", "copies", "gone")
    last = last.mapInArrow(cut, "h1 long, h2 int, n_words long, n_removed long, kept_sha256 string").dropDuplicates(["h1", "h2"])
    last = written(last, "outcomes")  # so that rows of a text with very many copies can be split between tasks
    return rows.select("doc_id", "h1", "h2").join(last, ["h1", "h2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
