"""Files that grow: a streaming source of the lines appended to text files, by byte offset.

The offset of a stream is the length of every file. A batch takes the bytes between two offsets in ranges, many tasks at
a time, and a line belongs to the range in which its line feed lies: so a line that is only half there waits for the rest,
and none is lost or doubled over batches, ranges and restarts. Offsets are kept in the stream's checkpoint. Files are
listed and read by pyarrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_package
from .binary_logs import opened

RANGE_BYTES, BATCH = 32 << 20, 50_000


class Piece(InputPartition):
    """Bytes begin to end of a file."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def line_start(file, begin: int, block: int = 1 << 16) -> int:
    """Where the line begins that the byte before `begin` is in, or `begin` itself behind a line feed."""
    at = begin
    while at > 0:
        low = max(0, at - block)
        found = file.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_of(file, begin: int, end: int, block: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines whose line feeds lie from begin to end."""
    start, rest, at = line_start(file, begin), b"", begin
    rest = file.read_at(begin - start, start) if start < begin else b""
    while at < end:
        data = file.read_at(min(block, end - at), at)
        if not data:
            return
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield start, line.removesuffix(b"\r")
            start += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, range_bytes: int):
        self.path, self.suffix, self.range_bytes = path, suffix, range_bytes

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, folder = opened(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        files = {f.base_name: f.size for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(self.suffix) and f.base_name[0] not in "._"}
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A file that is shorter than before has begun anew and is read from its start."""
        old, new = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for name, size in new.items():
            begin = old.get(name, 0) if old.get(name, 0) <= size else 0
            out += [Piece(name, at, min(at + self.range_bytes, size)) for at in range(begin, size, self.range_bytes)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(self.path)
        file = fs.open_input_file(f"{folder}/{partition.file}")
        log = f"{self.path}/{partition.file}"

        def batch(places: list[int], texts: list[bytes]) -> pa.RecordBatch:
            texts = pa.array([t.decode(errors="replace") for t in texts], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([log] * len(places)), pa.array(places, pa.int64()), texts], names=["log", "frame_no", "value"])

        places, texts = [], []
        for place, text in lines_of(file, partition.begin, partition.end):
            places.append(place)
            texts.append(text)
            if len(places) == BATCH:
                yield batch(places, texts)
                places, texts = [], []
        if places:
            yield batch(places, texts)

    def commit(self, end: dict) -> None:
        pass


class TailedLines(DataSource):
    """Options: path (a folder), suffix (of file names), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return "log string, frame_no long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"].rstrip("/"), self.options.get("suffix", ""), int(self.options.get("range_bytes", RANGE_BYTES)))


def tail_lines(spark: SparkSession, folder: str, *, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of log (file), frame_no (the line's place in it), value of every whole line of the files of a folder, those
    appended later and those of new files with them."""
    ship_package(spark)
    spark.dataSource.register(TailedLines)
    return spark.readStream.format("tailed_lines").option("path", folder).option("suffix", suffix).option("range_bytes", range_bytes).load()


def tail_candump(spark: SparkSession, folder: str, channels: Sequence[str] = (), **options) -> DataFrame:
    """Frames of candump logs that grow, as a stream; iface is a channel's place in channels, null for others (a recording
    gives numbers of its own: `ops.record_log`)."""
    from .text_logs import parse_candump

    return parse_candump(tail_lines(spark, folder, **options), list(channels))
