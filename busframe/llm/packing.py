"""Best-fit packing of tokenised documents into fixed-length sequences, under several capacities at once.

Vector best-fit: a bin has a residual of tokens, of documents and of attention cost. Items go in by falling
length; of the open bins that fit in every dimension, the one with the best score takes the item. Score "dot" is
the weighted dot product of the item's demand and the bin's residual (both as shares of the capacity; the smallest
wins, so that the fullest bin is filled), "norm" the weighted norm of the residual that would be left.

Scale: texts are tokenised where they are read and never shuffled; only (document, piece, length) rows move. Full
pieces need no search. The others are dealt at random to groups of about `group_items`, and every group is packed
by itself, so no task or group grows with the input; a group wastes less than one sequence more than a global pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[tuple[str, str], object] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary. tiktoken gives the ids of the tokenizers file several times faster;
    texts with a special token's string go through the tokenizers file itself."""

    def __init__(self, name: str):
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        lines = Path(public_tokenizers.path(f"{name}.tiktoken")).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k", end_id: int = 2, length: int = 1024) -> DataFrame:
    """One row per piece of each document's ids: only documents longer than `length` are cut, into full pieces of
    which the first may be shorter. A null text is empty and has the end id alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                head = len(ids) % length or length
                edges = [0, *range(head, len(ids) + 1, length)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def best_fit(lengths: np.ndarray, costs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str) -> np.ndarray:
    """Bin of each item. Bins are open until full in one dimension."""
    order = np.lexsort((-costs, -lengths))
    left = np.zeros((len(lengths), 3))
    out = np.zeros(len(lengths), np.int64)
    live, made = np.zeros(0, np.int64), 0
    for i in order:
        need = np.array([lengths[i], 1.0, costs[i]])
        rest = left[live]
        fit = np.flatnonzero((rest >= need).all(1))
        if len(fit):
            share = rest[fit] / capacity
            value = share @ (weights * need / capacity) if score == "dot" else ((share - need / capacity) ** 2) @ weights
            b = live[fit[np.argmin(value)]]
        else:
            b, made = made, made + 1
            left[b] = capacity
            live = np.append(live, b)
        left[b] -= need
        out[i] = b
        if left[b].min() <= 0 or left[b, 0] < lengths[order[-1]]:
            live = live[live != b]
    return out


def pack(
    pieces: DataFrame, *, length: int = 1024, max_docs: int = 1024, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm", group_items: int = 8000,
) -> DataFrame:
    """Adds sequence_id and offset (place in the sequence, gapless from 0). The attention cost of a piece is the
    square of its length; max_cost None stands for length squared, which no set of pieces within `length` exceeds.
    A piece that by itself exceeds a capacity (cost) gets a sequence of its own. Full pieces have negative ids. A column
    `row` of pieces, where there is one, is a number of each row and isn't returned."""
    capacity = np.array([length, max_docs, max_cost or length**2], float)
    if score not in ("dot", "norm"):
        raise ValueError(f"unknown score {score!r}")
    short = F.col("length") < length
    groups = max(1, -(-pieces.filter(short).count() // group_items))
    # a row's own number deals it out, so that equal rows spread over the groups
    own = F.col("row") if "row" in pieces.columns else F.monotonically_increasing_id()
    parts = pieces.withColumn("group", F.when(short, F.pmod(F.xxhash64(own), F.lit(groups))).otherwise(F.lit(-1).cast("long"))).drop("row")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        size = group.length.to_numpy(float)
        alone = (size**2 > capacity[2]) | (size > capacity[0])
        bins = np.zeros(len(group), np.int64)
        bins[~alone] = best_fit(size[~alone], size[~alone] ** 2, capacity, np.array(weights), score)
        bins[alone] = (bins[~alone].max() + 1 if (~alone).any() else 0) + np.arange(alone.sum())
        group = group.assign(bin=bins).sort_values(["bin", "length", "doc_id", "piece"], ascending=[True, False, True, True], kind="stable")
        group["offset"] = group.groupby("bin").length.cumsum() - group.length
        return group.assign(sequence_id=group.group + group.bin * groups)[[*base, "sequence_id", "offset"]]

    base = [c for c in pieces.columns if c != "row"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in base) + ", sequence_id long, offset long"
    packed = parts.filter("group >= 0").groupBy("group").applyInPandas(fill, schema)
    full = parts.filter("group < 0").select(
        *base, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, *, length: int = 1024, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Texts that are null or empty are one piece of the end id alone. Rows may repeat: each is packed."""
    pieces = written(token_pieces(docs, length=length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, length=length, **options)
