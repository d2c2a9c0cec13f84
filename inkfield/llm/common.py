"""What the operators share: table access, scratch tables and small helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_counted  # noqa: F401
from ..sources.scratch import drop_path, scope, stash, write_kept  # noqa: F401

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Texts, and bytes of texts, that ``portions`` puts in one batch.
BATCH, BATCH_BYTES = 256, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_table(df: DataFrame, label: str) -> DataFrame:
    return write_kept(df, label)[0]


def pieces(n_rows: int, per_piece: int, least: int) -> int:
    """How many partitions hold ``n_rows`` at about ``per_piece`` each; never under ``least``."""
    return max(least, -(-n_rows // per_piece))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def batches(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, so that very long texts do not pile up."""
    for b in it:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def portions(it: Iterator[pa.RecordBatch], column: int, rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows and, but for single rows, about ``BATCH_BYTES`` of text in a column."""
    for b in batches(it, rows):
        at = size = 0
        for i, n in enumerate(pc.binary_length(b.column(column)).to_numpy().tolist()):
            if size and size + n > BATCH_BYTES:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
