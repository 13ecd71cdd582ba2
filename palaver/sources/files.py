"""Listing of files that may hold conversations. Only paths and lengths are read, not contents."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def data_dirs(candidates: list[str] | None = None) -> list[str]:
    """Those of the folders that exist; by default places where desktop applications keep data."""
    home = Path.home()
    places = candidates or [os.environ.get("XDG_CONFIG_HOME") or str(home / ".config"), str(home / ".local/share"), str(home / "Library/Application Support"), os.environ.get("APPDATA", ""), os.environ.get("LOCALAPPDATA", "")]
    return [p for p in places if p and os.path.isdir(p)]


def list_files(spark: SparkSession, path: str, most: int = 60) -> DataFrame:
    """path, kb and label of the files among the first ``most`` entries of a folder by path, part by part; folders that hold files are entries, too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    fixed = re.split(r"[*?\[{]", path)[0]
    root = spark._jvm.org.apache.hadoop.fs.Path((fixed if fixed == path else fixed.rpartition("/")[0]) or ".")
    depth = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/").count("/") + 1
    listed = files.withColumn("parts", F.split("path", "/"))
    above = F.transform(F.sequence(F.lit(depth), F.greatest(F.lit(depth), F.size("parts") - 1)), lambda k: F.slice("parts", F.lit(1), k))
    folders = listed.select(F.explode(above).alias("parts")).distinct().where(F.size("parts") > depth)
    entries = listed.unionByName(folders, allowMissingColumns=True).orderBy("parts").limit(most).where("path IS NOT NULL")
    name = F.lower(F.element_at("parts", -1))
    label = (
        F.when(name.rlike(r"\.(sqlite3?|db)$"), "sqlite").when(name.endswith(".jsonl"), "jsonl").when(name.rlike(r"config.*\.json$"), "config json")
        .when(name.rlike(r"\.(ldb|leveldb)$") | F.lower("path").contains("leveldb") | F.lower("path").contains("indexeddb"), "leveldb").otherwise("other")
    )
    return entries.select("path", F.floor(F.col("bytes") / 1024).alias("kb"), label.alias("label")).orderBy("path")


def host_config(candidates: list[str] | None = None) -> str | None:
    """The first JSON configuration of a host application that exists: the one that ``PALAVER_HOST_CONFIG`` names, or in a folder of ``data_dirs``."""
    named = os.environ.get("PALAVER_HOST_CONFIG")
    found = candidates or ([named] if named else [str(p) for d in data_dirs() for p in sorted(Path(d).glob("*/*_desktop_config.json"))])
    return next((p for p in found if os.path.isfile(p)), None)


def configured_servers(config: str) -> list[str]:
    """Names of the servers in a host application's JSON configuration; none if it can't be read."""
    try:
        return sorted(json.loads(Path(config).read_text(encoding="utf-8")).get("mcpServers", {}))
    except (OSError, ValueError, AttributeError):
        return []
