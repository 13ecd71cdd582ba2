"""Files that are created once: the one thing that savers who know nothing of each other have to agree on.

A file appears with its whole content or not at all, and only one of several that create it at once succeeds. On a local file system that is a hard link, elsewhere a
rename, which must fail where there is a file already and be atomic, as it is on HDFS; object stores without such a rename don't do.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small text files on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._jvm, self._root = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)
        here = self._fs.makeQualified(self._root).toUri()
        self._local = here.getPath() if here.getScheme() == "file" else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self) -> list[str]:
        """Names of the files, in order."""
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(self._root)) if not n.startswith((".", "_")))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file; false if there is one of that name."""
        hidden = f".{name}-{uuid.uuid4().hex}"
        if self._local is not None:
            temporary = os.path.join(self._local, hidden)
            try:
                with open(temporary, "x", encoding="utf-8") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(temporary, os.path.join(self._local, name))
                return True
            except FileExistsError:
                return False
            finally:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(temporary)
        stream = self._fs.create(self._path(hidden), False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if self._fs.rename(self._path(hidden), self._path(name)):
            return True
        self._fs.delete(self._path(hidden), False)
        return False

    def delete(self, name: str) -> None:
        """Delete a file, or a folder with all that is in it."""
        self._fs.delete(self._path(name), True)


def number_of(name: str) -> int:
    """The number in the name of a version's file, -1 if it is none."""
    digits = name.removeprefix("v").removesuffix(".json")
    return int(digits) if digits.isdigit() else -1


def name_of(number: int) -> str:
    return f"v{number:09d}.json"
