"""Shards of equal bytes by histogram sort: exact bytes below probe keys, refined until splitters are good enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.tables import joinable, stored, without

TOLERANCE = 0.0005
PROBES = 256
RUN_BYTES = 64 << 20
_LOW, _HIGH = -(1 << 63), 1 << 63
_HISTOGRAM = pa.schema([("at", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64())])


def _histogram(probes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(probes) + 1, 2), np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("key").to_numpy(), side="right")
            np.add.at(total[:, 0], at, batch.column("size").to_numpy())
            total[:, 1] += np.bincount(at, minlength=len(total))
        used = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used, 0]), pa.array(total[used, 1])], schema=_HISTOGRAM)

    return run


def _below(keyed: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes of the rows with a key below each probe."""
    parts = keyed.mapInArrow(_histogram(np.array(probes, np.int64)), "at long, bytes long, rows long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect()
    bins = np.zeros(len(probes) + 1, np.int64)
    for at, size in parts:
        bins[at] = size
    return np.cumsum(bins)[:-1].tolist()


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys that cut the rows of ``keyed`` (key long, size long) into ``shards`` ranges of nearly equal bytes.

    Each round counts the bytes below evenly spaced probes inside every interval that still holds a wanted boundary;
    a boundary is settled when a probe is within ``tolerance`` of a shard's bytes or no key lies between the ends.
    The driver sees (shards - 1) * PROBES counts per round, whatever the data.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goals = [total * j // shards for j in range(1, shards)]
    ends = [[_LOW, 0, _HIGH, total] for _ in goals]  # of each: key and bytes below at both ends
    near = tolerance * total / shards

    def settled(goal: int, end: list[int]) -> bool:
        return min(goal - end[1], end[3] - goal) <= near or end[2] - end[0] <= 1 or end[1] == end[3]

    while any(not settled(g, e) for g, e in zip(goals, ends)):
        probes = sorted({lo + (hi - lo) * i // PROBES for g, e in zip(goals, ends) if not settled(g, e) for lo, hi in [(e[0], e[2])] for i in range(1, PROBES)} - {_LOW, _HIGH})
        counted = list(zip(probes, _below(keyed, probes)))
        for goal, end in zip(goals, ends):
            for key, below in counted:
                if end[0] < key < end[2]:
                    if below <= goal:
                        end[0], end[1] = key, below
                    else:
                        end[2], end[3] = key, below
                        break
    return [lo if goal - a <= b - goal else min(hi, _HIGH - 1) for goal, (lo, a, hi, b) in zip(goals, ends)]


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds size, shard and slot: shards of nearly equal bytes, rows inside in the order of a hash of id and text.

    size: UTF-8 bytes of the text plus 8. Rows are dealt by ranges of the hash, so every shard is a random sample and
    the shards one after the other are the hash order. Boundaries come from ``splitters`` over a narrow checkpointed
    table; then each row moves once, in runs of about 64 MB (a shard is many runs), and slot is its rank in the run
    plus the rows of the shard's earlier runs, counted without moving texts.

    The low bits of a key come from a hash of the row's position, so rows repeated whole are dealt over shards like any
    others, whatever their number, and those of a group that alone fills an eighth of a run over tasks. Positions are
    fixed by writing the rows once. How the input is split only decides which of several equal rows gets which place,
    and, where a shard ends among equal rows, how many of them it takes within the tolerance.

    Null texts count 8 bytes, null ids are hashed as such. An empty table gives an empty result. Extra columns pass
    through; input columns named size, shard or slot give way.
    """
    docs = without(docs, ["size", "shard", "slot"])
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(0xFFFF)
    key = F.xxhash64("doc_id", "text").bitwiseAND(-0x10000).bitwiseOR(place)
    own = stored(docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).withColumn("__key", key))
    keyed = own.select(F.col("__key").alias("key"), "size")
    alike = F.shiftright("__key", 16)
    heavy = keyed.withColumnRenamed("key", "__key").groupBy(alike.alias("__alike")).agg(F.sum("size").alias("bytes"))
    heavy = joinable(heavy.where(F.col("bytes") > RUN_BYTES // 8).select("__alike"))
    own = own.join(heavy, alike == F.col("__alike"), "left")
    fine = F.when(F.col("__alike").isNotNull(), F.col("__key").bitwiseAND(0xFF) + 1).otherwise(0)
    bounds = splitters(keyed, shards, tolerance)
    volume = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(1, (volume // RUN_BYTES).bit_length())
    shard = sum(((F.col("__key") >= b).cast("int") for b in bounds), F.lit(0))
    run = F.shiftright("__key", 64 - bits)
    dealt = own.withColumns({"shard": shard, "__run": run, "__fine": fine}).drop("__alike")
    runs = dealt.groupBy("shard", "__run", "__fine").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__run", "__fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "__run", "__fine", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("shard", "__run", "__fine").orderBy("__key", "doc_id"))
    placed = dealt.withColumn("__rank", rank).join(offsets, ["shard", "__run", "__fine"])
    return placed.withColumn("slot", F.col("__before") + F.col("__rank") - 1).drop("__key", "__run", "__fine", "__rank", "__before")
