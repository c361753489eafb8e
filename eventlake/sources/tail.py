"""Growing log files as a stream: byte offsets per file, and a last line without its end is held back.

    spark.dataSource.register(TailSource)
    spark.readStream.format("eventlake_tail").load("/shared/logs")

A trigger takes every file up to its last line end. What comes after it is no line yet: it stays for a later trigger, which
sees it whole. A file that became shorter than its offset was cut or replaced and is read from its beginning. Ranges are
dealt as pieces of `PIECE` bytes; a line belongs to the piece in which it begins. Files must lie in a folder that driver
and executors share; hidden files (`.x`, `_x`) are left out, and subfolders are read too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
BLOCK = 1 << 16
ROWS = 10_000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [start, end); first is where the range of the trigger begins."""

    path: str
    first: int
    start: int
    end: int


def last_line_end(path: str, size: int) -> int:
    """Offset after the last line feed below `size`, found from the back in blocks."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            lo = max(0, at - BLOCK)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return 0


def lines_of(piece: Piece) -> Iterator[bytes]:
    with open(piece.path, "rb") as f:
        f.seek(piece.start)
        if piece.start > piece.first:
            # a line that began before is the business of the piece before
            f.seek(piece.start - 1)
            f.readline()
        at = f.tell()
        while at < piece.end:
            line = f.readline()
            if not line:
                break
            at += len(line)
            yield line[:-2] if line.endswith(b"\r\n") else line.removesuffix(b"\n")


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def files(self) -> Iterator[str]:
        if os.path.isfile(self.path):
            yield self.path
        for folder, inner, names in os.walk(self.path):
            inner[:] = [d for d in inner if d[0] not in "._"]
            yield from (os.path.join(folder, n) for n in names if n[0] not in "._")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: last_line_end(p, os.path.getsize(p)) for p in sorted(self.files())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, to in end.items():
            at = start.get(path, 0)
            at = at if at <= to else 0
            out += [Piece(path, at, i, min(i + PIECE, to)) for i in range(at, to, PIECE)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([piece.path] * len(held))], ["line", "peer"])

        for line in lines_of(piece):
            held.append(line)
            if len(held) >= ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventlake_tail"

    def schema(self) -> str:
        return "line binary, peer string"

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001, N802
        return TailReader(self.options["path"])


def tailed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stream of lines in the shape of `readers.log_lines`: raw with the bytes as they are, and peer, the file."""
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format(TailSource.name()).load(path)
    return rows.select(F.col("line").cast("string").alias("raw"), "peer")
