"""N-gram Jaccard join: a MinHash LSH forest over sets of word n-grams, then exact verification.

1. Every distinct n-gram set is signed with `trees` x `labels` minhash labels; a tree of the forest is the prefix trie
   of its labels, kept as sorted rows.
2. The target recall sets how far a matched prefix is shortened at most: to the longest depth at which a pair at the
   threshold, 1 - (1 - t**depth)**trees, is found with that chance. Rows that share such a prefix are dealt out together
   and sorted by their full labels. From there matched prefixes are shortened level by level, from the full depth: at
   each level the runs that have grown are looked at, and of a run only the rows that no earlier row of it stands for.
   So rows with long common prefixes are settled among themselves, and only their leaders go on to shorter ones.
3. Two rows are linked only if their whole signatures agree well enough: pairs below the threshold, which short prefixes
   bring together by chance, don't chain. A leader stands for rows within three quarters of the threshold's distance,
   and is linked to all within that and the threshold's distance together, so that no pair at the threshold falls
   between two leaders. A task keeps only the links of a spanning forest, fewer than it has rows.
4. Components of these links are the candidate groups. Inside a group the Jaccard similarity of all members is computed
   exactly, in blocks: a group of many or large sets is dealt out to blocks by a hash and each pair of blocks is one
   task; what leaves it are counts and components, never the pairs.

Documents with equal n-gram sets are one class from the start, so exact copies cost one row each. Prefixes with more than
BUCKET_ROWS rows are dealt out to parts by a hash of the row, and each pair of parts is walked as one, so that every two
rows of a prefix meet, however many it has; what a task holds stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import document_key, gram_hashes, hash_words, mix, written

BLOCK_SETS, BLOCK_GRAMS = 1500, 3_000_000
BUCKET_ROWS, GROUP_ROWS = 4096, 20_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-case words; a shorter text is one n-gram, no words none."""
    words = hash_words((text or "").lower().encode())[0]
    return np.unique(gram_hashes(words, n) if len(words) >= n else gram_hashes(words, len(words)) if len(words) else words)


def prefix_depth(similarity: float, trees: int, labels: int, recall: float) -> int:
    """The longest prefix that still reaches the recall at the threshold; at least 1."""
    depth = labels
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def minhash(grams: np.ndarray, size: int) -> np.ndarray:
    """`size` labels of 16 bits, each of the smallest of its own hashes of the grams."""
    rng = np.random.default_rng(11)
    a = rng.integers(1, 1 << 30, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    one = (mix(grams) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(grams), 1024):
        x = one[None, at : at + 1024] * a[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += b[:, None]
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(1), out=out)
    return (mix(out.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """dk (the row's document key), h (hash of its text), set_a, set_b (hash of the n-gram set), grams (their number) and
    labels (in bytes), of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, labels = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, n)
                sizes.append(len(grams))
                if not len(grams):
                    sets.append((0, 0))
                    labels.append(None)
                    continue
                sets.append(tuple(int(x) for x in (np.bitwise_xor.reduce(mix(grams)), (mix(grams + np.uint64(99)) * np.uint64(31)).sum())))
                labels.append(minhash(grams, size).astype(">u2").tobytes())
            both = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dk"), batch.column("h"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())],
                names=["doc_id", "dk", "h", "set_a", "set_b", "grams", "labels"],
            )

    rows = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "dk", "h", "text")
    return rows.mapInArrow(run, "doc_id long, dk long, h long, set_a long, set_b long, grams long, labels binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", document_key(F.col("doc_id"), F.col("text"), last=True).alias("dk"), F.xxhash64("text").alias("h"), "text")


def roots_of(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Roots of nodes in a forest of parents, which is flattened on the way."""
    top = parent[nodes]
    while (parent[top] != top).any():
        top = parent[top]
    parent[nodes] = top
    return top


def trie_links(
    ids: np.ndarray, signs: np.ndarray, own: np.ndarray, least: int, loose: float, tight: float, nodes: np.ndarray | None = None, parent: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links among rows that share `least` labels of one tree. signs: all labels of each row, own: those of the tree. Rows
    are sorted as in the trie and matched prefixes shortened from the full depth. Only links that join what no link has
    joined before are returned: nodes are the rows' places in parent, a forest that several calls may share."""
    if nodes is None or parent is None:
        nodes, parent = np.arange(len(ids)), np.arange(len(ids))
    order = np.lexsort(own.T[::-1])
    ids, signs, own, nodes = ids[order], signs[order], own[order], nodes[order]
    shared = np.concatenate(([0], np.where((own[1:] != own[:-1]).any(1), (own[1:] != own[:-1]).argmax(1), own.shape[1])))  # with the row before
    settled = np.zeros(len(ids), bool)
    links = []
    for depth in range(own.shape[1], least - 1, -1):
        grown = shared == depth
        if not grown.any():
            continue
        run = np.cumsum(shared < depth)
        for r in np.unique(run[grown]):
            a, b = np.searchsorted(run, [r, r + 1])
            rest = a + np.flatnonzero(~settled[a:b])
            rest = rest[np.argsort(ids[rest])]  # the smallest id leads, so that trees agree on leaders
            while len(rest) > 1:
                top = roots_of(parent, nodes[rest])
                if (top == top[0]).all():
                    break
                alike = (signs[rest[1:]] == signs[rest[0]]).mean(1)
                joined, first = np.unique(top[1:][alike >= loose], return_index=True)
                near = rest[1:][alike >= loose][first]
                links += [(int(ids[i]), int(ids[rest[0]])) for i, t in zip(near, joined, strict=True) if t != top[0]]
                every = np.append(joined, top[0])
                parent[every] = every.min()
                settled[rest[1:][alike >= tight]] = True
                rest = rest[1:][alike < tight]
    return links


def candidate_links(sets: DataFrame, *, similarity: float, trees: int, labels: int, recall: float) -> DataFrame:
    """Links (a, b) between rows (sid, labels) whose signatures agree well enough, through prefixes of the forest."""
    least = prefix_depth(similarity, trees, labels, recall)
    apart = 1 - similarity
    tight, loose = 1 - 0.75 * apart, 1 - 1.75 * apart - 0.05
    prefix = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("labels", 2 * labels * t + 1, 2 * least)).alias("key"))
    keys = sets.select("sid", F.explode(F.array(*[prefix(t) for t in range(trees)])).alias("x")).select("sid", "x.tree", "x.key")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # two parts at a time are walked
    shared = written(shared.select("key", F.when(F.col("n") <= BUCKET_ROWS, 1).otherwise(F.ceil(2 * F.col("n") / BUCKET_ROWS)).cast("int").alias("parts"), "n"), "prefixes")
    n_groups = max(1, -(-(shared.agg(F.sum(F.col("n") * F.greatest(F.col("parts") - 1, F.lit(1)))).first()[0] or 0) // GROUP_ROWS))
    # a row goes to every pair that its part is in
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
    pair = F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")
    met = keys.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).select("sid", "tree", "key", "parts", "own", F.explode(other).alias("other"))
    met = met.select("sid", "tree", "key", pair.alias("part"))
    met = met.withColumn("grp", F.pmod(F.xxhash64("key", "part"), F.lit(n_groups)))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "part"], ignore_index=True)
        signs = np.frombuffer(b"".join(group.labels), ">u2").astype(np.uint16).reshape(len(group), trees * labels)
        ids, tree, key, part = (group[c].to_numpy() for c in ("sid", "tree", "key", "part"))
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True])))
        nodes = np.unique(ids, return_inverse=True)[1]
        parent, links = np.arange(len(ids)), []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                t = int(tree[a])
                links += trie_links(ids[a:b], signs[a:b], signs[a:b, t * labels : (t + 1) * labels], least, loose, tight, nodes[a:b], parent)
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return met.join(sets.select("sid", "labels"), "sid").groupBy("grp").applyInPandas(walk, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component of links (a, b). In a round every node goes to its smallest
    neighbour, if that is smaller than itself, and on to where that one goes; then links join the nodes gone to, and
    those within one node fall away. So every round leaves fewer links, and it ends when none is left. Rounds are
    written, so their plans are short, and a node of many links can be split between tasks."""
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = written(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("root", F.col("id")), "roots")
    while not links.isEmpty():
        low = links.select("a", "b").union(links.select("b", "a")).toDF("node", "near").groupBy("node").agg(F.min("near").alias("near"))
        step = written(low.select("node", F.least("node", "near").alias("to")), "steps")
        there = step.select(F.col("node").alias("mid"), F.col("to").alias("last"))
        step = written(step.join(there, F.col("to") == F.col("mid")).select("node", F.col("last").alias("to")), "steps")
        of = lambda c: step.select(F.col("node").alias(f"_{c}"), F.col("to").alias(f"to_{c}"))
        moved = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).filter("to_a <> to_b")
        links = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        roots = written(roots.join(of("r"), F.col("root") == F.col("_r"), "left").select("id", F.coalesce("to_r", "root").alias("root")), "roots")
    return roots


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the documents linked to it, over any number of links) and n_links (other rows
    with at least this similarity), one row per row.

    Texts that are null or without words have no links and are each their own class. Rows count by their texts: repeated
    rows are links of each other, and different texts under one doc_id are different documents. A null doc_id counts as
    larger than any in the choice of class_id, and is null where no other is there. options: those of `classes`."""
    out = classes(docs, **options)
    named = F.when(F.col("class_one.dk") < (1 << 62), F.col("class_one.dk"))
    return out.select("doc_id", F.when(F.col("class_one").isNull(), F.col("doc_id")).otherwise(named).alias("class_id"), "n_links")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """dk, h: document key and text hash (of `keyed_texts`) of one document of each class, the one with the smallest key;
    one row each."""
    out = classes(docs, **options)
    first = F.col("class_one").isNull() | ((F.col("dk") == F.col("class_one.dk")) & (F.col("h").eqNullSafe(F.col("class_one.h"))))
    return out.filter(first).select("dk", "h").distinct()


def classes(
    docs: DataFrame, *, n: int = 5, similarity: float = 0.8, trees: int = 20, labels: int = 12, recall: float = 0.999,
) -> DataFrame:
    """doc_id, dk, h, class_one (key and text hash of the first document of the class; null for texts without words) and
    n_links, one row per row."""
    ship_package(docs.sparkSession)
    signed = written(signatures(docs, n, trees * labels), "signatures")
    keyed = ["set_a", "set_b"]
    sets = signed.filter("grams > 0").groupBy(*keyed).agg(F.min(F.struct("dk", "h")).alias("one"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("labels").alias("labels"))
    sets = written(sets.select(*keyed, "one.dk", "one.h", "copies", "grams", "labels", F.monotonically_increasing_id().alias("sid")), "sets")
    links = candidate_links(sets, similarity=similarity, trees=trees, labels=labels, recall=recall)
    groups = components(links).withColumnRenamed("root", "group")

    members = groups.join(sets.select(F.col("sid").alias("id"), "dk", "h", "copies", "grams"), "id")
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    members = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a text of each set; repeated rows come once
    members = members.join(keyed_texts(docs).drop("doc_id"), ["dk", "h"]).groupBy("id", "group", "copies", "block", "blocks").agg(F.first("text").alias("text"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("group", "id", "copies", "block", "text", each).select(
        "id", "group", "copies", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        i, j = int(batch.i.iloc[0]), int(batch.j.iloc[0])
        own = [shingles(t, n) for t in batch.text]
        size = np.array([len(x) for x in own], np.int64)
        grams, column = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(own)), size)
        often = np.bincount(column) > 1
        rank = np.cumsum(often) - 1
        use = often[column]
        row, column = row[use], rank[column[use]]
        common = np.zeros((len(own), len(own)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(own), min(4096, int(often.sum()) - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            common += part @ part.T
        near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
        np.fill_diagonal(near, False)
        ids, copies, block = batch.id.to_numpy(), batch.copies.to_numpy(), batch.block.to_numpy()
        if i != j:  # pairs inside one block belong to the task of that block alone
            near &= block[:, None] != block[None, :]
        low = ids.copy()
        for _ in range(len(ids)):
            new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(1))
            if (new == low).all():
                break
            low = new
        return pd.DataFrame({"id": ids, "links": near @ copies, "low": low})

    compared = dealt.groupBy("group", "i", "j").applyInPandas(compare, "id long, links long, low long")
    compared = written(compared, "compared")
    found = compared.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(compared.filter("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    own = F.struct("dk", "h")
    linked = roots.join(sets.select(F.col("sid").alias("id"), own.alias("own")), "id")
    firsts = linked.join(linked.groupBy("root").agg(F.min("own").alias("class_one")), "root").select("id", "class_one")
    verdict = sets.select(*keyed, F.col("sid").alias("id"), own.alias("own"), "copies").join(found, "id", "left").join(firsts, "id", "left")
    verdict = verdict.select(*keyed, F.coalesce("class_one", "own").alias("class_one"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.select("doc_id", "dk", "h", *keyed).join(verdict, keyed, "left")
    return out.select("doc_id", "dk", "h", "class_one", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
