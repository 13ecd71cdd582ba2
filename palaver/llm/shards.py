"""Sharding: contiguous shards of nearly equal bytes, cut from prefix sums over all rows.

Rows are sorted by a key across partitions; each partition sums up its own bytes and rows from its first row on and so gives a total; the totals of the partitions before it, a
few numbers each, make its sums global. The whole range of bytes is cut at equal targets: a row belongs to the shard that its middle falls into, so that a shard is
off its target by half a row at each end at most. Only keys and sizes are sorted. Rows are numbered before, in a written table, so rows of equal keys are told apart and can be split.

A row's size is the bytes of its text plus 1. Laws of sharding: this one is ``bytes``; groups of equal texts play no part in it, they stand where their keys stand.

Defined results: null keys come first; a null text has no bytes, as an empty one; rows of equal keys, and repeated rows, are next to each other in the order of reading; a row larger
than a target fills the shards that it covers, of which all but one stay empty; an empty table gives an empty result; further columns, whatever their names, stay within ``doc``. Texts
are never held whole by Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save, spare

SHARDS = 8
LAW = "bytes"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the partition's number, and bytes and rows before it in the partition."""
    part, size, place = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.num_rows
        ends = np.cumsum(b.column(1).to_numpy(), dtype=np.int64) + size
        before = np.r_[np.int64(size), ends[:-1]] if n else ends
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), b.column(0), b.column(1), pa.array(before), pa.array(np.arange(place, place + n))], ["part", "row", "size", "before", "place"])
        if n:
            size, place = int(ends[-1]), place + n


def places(sized: DataFrame, shards: int = SHARDS) -> DataFrame:
    """row, shard and slot of ``sized`` (row, key, size); slots count from 0 in each shard."""
    ordered = sized.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("row", "size")
    local = save(ordered.mapInArrow(_running, "part long, row long, size long, before long, place long"), "shard-sums")
    totals = local.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    offsets, total, n = [], 0, 0
    for r in totals:
        offsets.append((r["part"], total, n))
        total, n = total + r["size"], n + r["n"]
    known = sized.sparkSession.createDataFrame(offsets, "part long, bytes_before long, rows_before long")
    middle = F.col("before") * 2 + F.col("bytes_before") * 2 + F.col("size")
    target = F.expr(f"CAST(middle AS DECIMAL(20,0)) * {shards} DIV {max(1, 2 * total)}")
    numbered = local.join(known, "part").withColumn("middle", middle).select("row", F.least(target, F.lit(shards - 1)).cast("int").alias("shard"), (F.col("place") + F.col("rows_before")).alias("place"))
    starts = numbered.groupBy("shard").agg(F.min("place").alias("start"))
    return numbered.join(starts, "shard").select("row", "shard", (F.col("place") - F.col("start")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """doc (all columns of ``docs``), size, text_crc32, law, shard and slot of every row."""
    rows = save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "shard-rows")
    data = F.coalesce(F.col("doc.text").cast("string"), F.lit("")).cast("binary")
    sized = rows.select("row", F.col(f"doc.`{key}`").alias("key"), (F.octet_length(data) + 1).cast("long").alias("size"))
    placed = places(sized, shards)
    whole = rows.select("row", "doc", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return whole.join(placed, "row").select("doc", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot")


def write(sharded: DataFrame, path: str) -> None:
    """Write what ``shard`` returns as Parquet files, in a folder for each shard; their rows are in the order of the slots."""
    docs = sharded.select("doc.*")
    folder, slot = spare(docs, "shard"), spare(docs, "slot")
    out = sharded.select("doc.*", F.col("slot").alias(slot), F.col("shard").alias(folder))
    out.repartitionByRange(folder, slot).sortWithinPartitions(folder, slot).write.partitionBy(folder).parquet(path)
