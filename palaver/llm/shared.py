"""Shared-folder plumbing: written tables that cut lineage, and files that executors exchange."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palaver-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later plans start there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, name: str, *keys: Column) -> DataFrame:
    """A written table of ``df`` with each row's place, from 0, in the order of ``keys``.

    Rows are sorted across partitions and numbered in each; the numbers of rows in the partitions before are added, one number a partition.
    """
    at = F.monotonically_increasing_id()
    table = save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, at), "ranked")
    part = F.shiftright(name, 33)
    before, rows = [], 0
    for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((r["part"], rows))
        rows += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "part long, before long").alias("o")
    place = F.col("o.before") + F.col(f"t.{name}").bitwiseAND(F.lit((1 << 33) - 1))
    own = [place.alias(name) if c == name else F.col(f"t.`{c}`") for c in table.columns]
    return table.alias("t").join(offsets, F.shiftright(f"t.{name}", 33) == F.col("o.part")).select(*own)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])
