"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII letters folded to lower case and everything that separates words turned into blanks:
# words are runs of digits, letters and bytes above 0x7F, so UTF-8 sequences stay whole.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the session; a local one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/eventlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *, by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not by else spark.read.parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, stored: another scan of df may be split otherwise, and would number its rows otherwise."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), compression="zstd")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def raw(col: pa.Array) -> list[bytes | None]:
    """A text or binary column as bytes."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


