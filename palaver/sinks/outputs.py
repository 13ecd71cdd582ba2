"""Results that are replaced as a whole: a reader sees the old result or the new one, whatever happens to the run that writes.

A result is written to a folder of its own; a small file that is created last makes it the current one (``once``). A run that is killed leaves a folder that
no such file names. Of runs that write at once each gets a number, and the highest is current.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .once import Folder, name_of, number_of


def versions(spark: SparkSession, path: str) -> list[dict]:
    """What is known of the results, the current one first: number, folder and format."""
    files = Folder(spark, f"{path}/_versions")
    numbered = sorted(((number_of(n), n) for n in files.names()), reverse=True)
    return [json.loads(files.text(name)) | {"number": number} for number, name in numbered if number >= 0]


class Stage:
    """Where a result is written: ``folder`` becomes the current one, what is on the ``side`` goes."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.name = path, kind, f"data-{uuid.uuid4().hex}"
        self.folder = f"{path}/{self.name}"

    def side(self, name: str) -> str:
        return f"{self.path}/{self.name}-{name}"


@contextlib.contextmanager
def staged(spark: SparkSession, path: str, kind: str = "parquet", keep: int = 2) -> Iterator[Stage]:
    """A folder to write a result to, which becomes the current one at ``path`` at the end, unless something is raised. The ``keep`` latest results stay, for those who still read them."""
    out = Stage(path.rstrip("/"), kind)
    root = Folder(spark, out.path)
    try:
        yield out
        files, entry = Folder(spark, f"{out.path}/_versions"), json.dumps({"folder": out.name, "format": kind})
        while not files.create(name_of(max([0, *map(number_of, files.names())]) + 1), entry):
            pass  # another run has got this number
    finally:
        for name in root.names():
            if name.startswith(f"{out.name}-"):
                root.delete(name)
    for old in versions(spark, out.path)[keep:]:
        files.delete(name_of(old["number"]))
        root.delete(old["folder"])


def write_output(df: DataFrame, path: str, kind: str = "parquet", keep: int = 2) -> str:
    """Make ``df`` the current result at ``path``; the folder that holds it."""
    with staged(df.sparkSession, path, kind, keep) as out:
        df.write.format(kind).save(out.folder)
    return out.folder


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """The current result at ``path``."""
    path = path.rstrip("/")
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no result at {path}")
    return spark.read.format(found[0]["format"]).load(f"{path}/{found[0]['folder']}")


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that no version names, as killed runs leave them. Not to be called while another run writes."""
    root = Folder(spark, path)
    named = {v["folder"] for v in versions(spark, path)}
    left = [n for n in root.names() if n.startswith("data-") and n not in named]
    for name in left:
        root.delete(name)
    return left


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, in the folder that driver and executors share: ``spark.checkpoint.dir``; on one machine without that, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="palaver-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
