"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

1. Documents are sets of word shingles; those with equal sets are one class from the start. A set is signed by
   SuperMinHash: each shingle draws a random permutation of the signature's places step by step, and in step j offers
   j plus a random fraction to its j-th place; a place keeps the smallest offer. The ranks of one shingle are correlated,
   which makes the share of equal places a better estimate than independent hashes give, and no step beyond the largest
   offer kept can change anything, so most sets are signed after one or two steps.
2. Bands of the signature are keys; rows with an equal key meet. Among them, leaders stand for rows whose whole signatures
   are nearly theirs, and rows within reach of a leader are joined to it by union-find, so a task keeps a spanning forest
   and no pairs. This only gathers candidates: the bound is loose by three deviations of the estimate.
3. Components of these links are the candidate groups. Inside them all sets are compared exactly, in blocks, by
   100 * intersection >= percent * union; union-find over the links of a block and over all blocks gives the classes.

Scale: a band is a row of two numbers for each distinct set; copies cost one row each. A key with more than BUCKET_ROWS
distinct sets is dealt out to pairs of parts, so every two of its rows meet in some task of bounded size. With bands of 5
and similarity 0.85, a pair is missed once in a million. The comparison of one group of near copies grows with the square
of its distinct sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import gram_hashes, hash_words, mix, written
from .jaccard import components, keyed_texts, roots_of

BLOCK_SETS, BLOCK_GRAMS = 1500, 3_000_000
BUCKET_ROWS, GROUP_ROWS = 16_384, 20_000
CHUNK = 2048


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words, A-Z in lower case; a shorter text is one n-gram, no words none."""
    words = hash_words((text or "").encode().lower())[0]
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else words


def superminhash(grams: np.ndarray, size: int) -> np.ndarray:
    """`size` values, step and fraction of the smallest offer, of a set that isn't empty."""
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, len(grams), CHUNK):
        x = mix(grams[at : at + CHUNK] ^ np.uint64(0x5851F42D4C957F2D))
        rows = np.arange(len(x))
        place = np.tile(np.arange(size, dtype=np.int32), (len(x), 1))
        for j in range(size):
            if best.max() < np.uint64(j << 32):  # every place has an offer of an earlier step
                break
            draw = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((draw & low) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
            here = place[rows, k]
            place[rows, k] = place[:, j]
            np.minimum.at(best, here, np.uint64(j << 32) | draw >> np.uint64(32))
    return best


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, dk (document key), h (hash of its text), set_a, set_b (hash of the set), grams (their number) and labels
    (16 bits of each value, in bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, labels = [], [], []
            for text in batch.column("text"):
                grams = shingles(text.as_py(), n)
                sizes.append(len(grams))
                sets.append((int(np.bitwise_xor.reduce(mix(grams))), int((mix(grams + np.uint64(99)) * np.uint64(31)).sum())) if len(grams) else (0, 0))
                labels.append((mix(superminhash(grams, size)) & np.uint64(0xFFFF)).astype(">u2").tobytes() if len(grams) else None)
            both = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "dk", "h")), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())],
                names=["doc_id", "dk", "h", "set_a", "set_b", "grams", "labels"],
            )

    rows = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "dk", "h", "text")
    return rows.mapInArrow(run, "doc_id long, dk long, h long, set_a long, set_b long, grams long, labels binary")


def bucket_links(ids: np.ndarray, signs: np.ndarray, nodes: np.ndarray, parent: np.ndarray, loose: float, tight: float) -> list[tuple[int, int]]:
    """Links of the rows of one bucket that join what no link has joined before; parent is a union-find over nodes. The
    smallest id leads; rows whose signatures agree with it by `tight` need no leader of their own, as whatever they may be
    linked to agrees with it by `loose`."""
    rest, links = np.argsort(ids), []
    while len(rest) > 1:
        top = roots_of(parent, nodes[rest])
        if (top == top[0]).all():
            break
        alike = (signs[rest[1:]] == signs[rest[0]]).mean(1)
        joined, first = np.unique(top[1:][alike >= loose], return_index=True)
        links += [(int(ids[i]), int(ids[rest[0]])) for i, t in zip(rest[1:][alike >= loose][first], joined, strict=True) if t != top[0]]
        every = np.append(joined, top[0])
        parent[every] = every.min()
        rest = rest[1:][alike < tight]
    return links


def candidate_links(sets: DataFrame, *, similarity: float, bands: int, rows: int) -> DataFrame:
    """Links (a, b) between rows (sid, labels) that share a band and whose signatures agree well enough."""
    apart, deviation = 1 - similarity, (0.25 / (bands * rows)) ** 0.5
    tight, loose = 1 - 0.75 * apart, 1 - 1.75 * apart - 3 * deviation
    band = lambda t: F.xxhash64(F.lit(t), F.substring("labels", 2 * rows * t + 1, 2 * rows))
    keys = sets.select("sid", F.explode(F.array(*[band(t) for t in range(bands)])).alias("key"))
    shared = keys.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    shared = written(shared.select("key", "n", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts")), "bands")
    n_groups = max(1, -(-(shared.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0) // GROUP_ROWS))
    met = keys.join(shared, "key").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("sid", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).withColumn("grp", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n_groups)))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "i", "j"], ignore_index=True)
        signs = np.frombuffer(b"".join(group.labels), ">u2").astype(np.uint16).reshape(len(group), bands * rows)
        ids, *at = (group[c].to_numpy() for c in ("sid", "key", "i", "j"))
        new = np.any([x[1:] != x[:-1] for x in at], axis=0)
        edge = np.flatnonzero(np.concatenate(([True], new, [True])))
        nodes = np.unique(ids, return_inverse=True)[1]
        parent, links = np.arange(len(ids)), []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                links += bucket_links(ids[a:b], signs[a:b], nodes[a:b], parent, loose, tight)
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return met.join(sets.select("sid", "labels"), "sid").groupBy("grp").applyInPandas(walk, "a long, b long").distinct()


def verified(own: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest place that links lead to: pairs with 100 * intersection >= percent * union. across: block
    of each set, where only pairs of different blocks count."""
    size = np.array([len(x) for x in own], np.int64)
    grams, column = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), size)
    often = np.bincount(column) > 1
    use = often[column]
    row, column = row[use], (np.cumsum(often) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(own), len(own)), np.float32)
    for at in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(own), min(4096, int(often.sum()) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if across is not None:
        near &= across[:, None] != across[None, :]
    parent = np.arange(len(own))
    for i in range(len(own)):
        top = np.unique(roots_of(parent, np.append(np.flatnonzero(near[i, :i]), i)))
        parent[top] = top[0]
    return roots_of(parent, np.arange(len(own)))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 85, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included) and kept, one row per
    row.

    A text of fewer than n words is one shingle; null texts and those without words have none and are linked with
    nothing. Repeated rows and equal sets are linked with each other. Different texts under one doc_id are documents of
    their own. A null doc_id counts as larger than any: it is never another's component_id, which is null where no
    document of the component has an id; such a document is kept if no other of its component comes before it (ids, then
    a hash of the text). For others kept is doc_id = component_id. Other columns aren't looked at. No documents: no rows."""
    ship_package(docs.sparkSession)
    signed = written(signatures(docs, n, bands * rows), "signatures")
    keyed = ["set_a", "set_b", "grams"]
    sets = signed.filter("grams > 0").groupBy(*keyed).agg(F.min(F.struct("dk", "h")).alias("one"), F.first("labels").alias("labels"))
    sets = written(sets.select(*keyed, "one", "labels", F.monotonically_increasing_id().alias("sid")), "sets")
    groups = components(candidate_links(sets, similarity=percent / 100, bands=bands, rows=rows)).withColumnRenamed("root", "group")

    members = groups.join(sets.select(F.col("sid").alias("id"), "one.dk", "one.h", "grams"), "id")
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    members = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a text of each set; repeated rows come once
    members = members.join(keyed_texts(docs).drop("doc_id"), ["dk", "h"]).groupBy("id", "group", "block", "blocks").agg(F.first("text").alias("text"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "group", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id", ignore_index=True)
        ids = batch.id.to_numpy()
        across = batch.block.to_numpy() if batch.i.iat[0] != batch.j.iat[0] else None
        low = ids[verified([shingles(t, n) for t in batch.text], percent, across)]
        return pd.DataFrame({"a": ids, "b": low})[low != ids]

    links = dealt.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")
    roots = components(links).join(sets.select(F.col("sid").alias("id"), "one"), "id")
    firsts = roots.join(roots.groupBy("root").agg(F.min("one").alias("first")), "root").select("id", "first")
    verdict = sets.select(*keyed, F.col("sid").alias("id"), "one").join(firsts, "id", "left").select(*keyed, F.coalesce("first", "one").alias("first"))
    out = signed.select("doc_id", "dk", "h", *keyed).join(verdict, keyed, "left")
    lone = F.col("first").isNull()
    named = F.when(lone, F.col("doc_id")).otherwise(F.when(F.col("first.dk") < (1 << 62), F.col("first.dk")))
    first = lone | ((F.col("dk") == F.col("first.dk")) & F.col("h").eqNullSafe(F.col("first.h")))
    kept = F.when(F.col("doc_id").isNull(), first).otherwise(F.coalesce(F.col("doc_id") == named, F.lit(False)))
    return out.select("doc_id", F.col("grams").alias("n_shingles"), named.alias("component_id"), kept.alias("kept"))
