"""Small helpers shared by the corpus operators: reading, column hygiene, lineage cuts, loops over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns an operator is about to produce: its own output wins over a clashing input column."""
    gone = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few hundred rows, so Python objects of few long texts are alive at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


PARTITION_ROWS = 200_000
PARTITION_BYTES = 48 << 20


def kept(df: DataFrame, rows: int = PARTITION_ROWS, size: str | None = None) -> DataFrame:
    """A checkpointed copy of a table in as few partitions as it asks for: one per ``rows`` rows, or, where ``size``
    is an expression of a row's bytes, one per PARTITION_BYTES."""
    df = cut(df)
    if size is None:
        parts = -(-df.count() // rows)
    else:
        parts = -(-(df.agg(F.sum(F.expr(size))).first()[0] or 0) // PARTITION_BYTES)
    return df.coalesce(max(1, parts))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints and read back: later passes read the columns they need."""
    spark = df.sparkSession
    cut(spark.range(0))  # settles the checkpoint folder
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid4().hex}"
    df.write.parquet(place)
    return spark.read.parquet(place)


BROADCAST_BYTES = 8 << 20


def joinable(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A checkpointed copy of a small side of a join, marked for broadcast if its measured size is within ``limit``.

    Beyond the limit the join is an ordinary one, which adaptive execution may split where keys are hot.
    """
    df = cut(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


__all__ = ["WORD", "cut", "is_empty", "joinable", "kept", "read", "slices", "stored", "text_bytes", "without"]
