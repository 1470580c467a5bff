"""Named files in any store that Spark reaches: written beside, then renamed, so that no reader sees half a file."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What a reset of files removes below the output folder: fixed values.
OUTPUTS, DEBUG = ("reviews", "results", "output"), ("debug_frames",)


class Files:
    """Files below a folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._path, conf = self._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._gateway = spark.sparkContext._gateway

    def at(self, name: str):
        return self._fs.makeQualified(self._path(self._path(self.root), self._path(None, None, name)))

    def names(self, folder: str) -> list[str]:
        p = self.at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.at(name), True)

    def write(self, name: str, data: bytes, replace: bool = True) -> bool:
        """Whether the file was written: without replace, not where it was there before."""
        folder, _, last = name.rpartition("/")
        beside = self.at(f"{folder}/.{last}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, False)
        out.write(bytearray(data))
        out.close()
        how = self._gateway.new_array(self._rename, 1)
        how[0] = self._rename.OVERWRITE if replace else self._rename.NONE
        try:
            self._context.rename(beside, self.at(name), how)
        except Exception:
            self._fs.delete(beside, False)
            if replace or not self.exists(name):
                raise
            return False
        return True


def write_thumbnails(files: Files, thumbs: DataFrame, folder: str) -> int:
    """Writes rows (name, data, replaces) to a folder in the order of pos, one after another: they are one video's, for a
    person to look at. Older files that match the pattern in replaces go first; a row without a name or data is skipped,
    and only * stands for anything in a pattern. Returns how many were written."""
    there, n = set(files.names(folder)), 0
    for r in thumbs.orderBy("pos").select("name", "data", "replaces").toLocalIterator():
        if not r["name"] or r["data"] is None:
            continue
        pattern = (r["replaces"] or "").replace("[", "[[]").replace("?", "[?]")
        for old in [x for x in there if pattern and fnmatch.fnmatchcase(x, pattern)]:
            files.delete(f"{folder}/{old}")
            there.discard(old)
        files.write(f"{folder}/{r['name']}", bytes(r["data"]))
        there.add(r["name"])
        n += 1
    return n


def reset_files(files: Files, outputs: bool, debug: bool, confirm: Callable[[str], bool]) -> list[str]:
    """Removes what was put out and the debug frames, each only if confirmed; returns the folders that went."""
    gone = []
    for wanted, folders, question in ((outputs, OUTPUTS, "Delete all output files?"), (debug, DEBUG, "Delete all debug frames?")):
        if wanted and confirm(question):
            gone += [f for f in folders if files.exists(f) and files.delete(f)]
    return gone
