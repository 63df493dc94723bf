"""What the operators share: tables, written intermediate results and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; longer texts are cut at white space.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors share no folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_key(doc_id: Column, text: Column, *, last: bool) -> Column:
    """The number that stands for a document: its doc_id, or where that is null 62 bits of a hash of its text, moved above
    (last) or below all ids between -2**62 and 2**62. Null-id rows are one document where their texts are equal."""
    hashed = F.xxhash64(F.lit("document"), text).bitwiseAND((1 << 62) - 1)
    return F.coalesce(doc_id.cast("long"), hashed + F.lit((1 << 62) if last else -(1 << 63)))


def unused(df: DataFrame, name: str) -> str:
    """The name, with so many underscores in front that df has no such column, in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Hashing of words. A word is a run of bytes other than space and \x09-\x0d.

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, STEP_BYTES + 1), _powers(_BASE_INVERSE, STEP_BYTES + 1)


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while len(data) - at > STEP_BYTES:
        cut = max(data.rfind(s, at, at + STEP_BYTES) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a step
            cut = next((i for i in range(at + STEP_BYTES, len(data)) if _SPACE[data[i]]), len(data))
        yield at, data[at:cut]
        at = cut
    yield at, data[at:]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word of data."""
    parts = []
    for at, segment in _segments(data):
        raw = np.frombuffer(segment, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = (_UP, _DOWN) if len(raw) <= STEP_BYTES else (_powers(_BASE, len(raw)), _powers(_BASE_INVERSE, len(raw)))
            sums = np.add.reduceat(_BYTES[raw] * up[: len(raw)], starts) * down[starts]
            parts.append((mix(sums + (ends - starts).astype(np.uint64)), starts + at, ends + at))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + count]
    return mix(out)
