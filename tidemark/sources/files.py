"""Small files and folders through Hadoop's file systems, so that any store Spark reaches will do."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self._jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]):
            raise OSError(f"cannot rename {old} to {new}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read_json(self, path: str, default=None):
        fs, p = self._at(path)
        if not fs.exists(p):
            return default
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_json(self, path: str, value) -> None:
        """Written aside and renamed over the old file, so that readers see the old or the new one."""
        aside = self._written(path, value)
        if not self.exists(path):
            return self.rename(aside, path)
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        p, q = fs.Path(aside), fs.Path(path)
        fs.FileContext.getFileContext(q.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q, how)

    def _written(self, path: str, value) -> str:
        aside = f"{path}.{uuid.uuid4().hex}.new"
        fs, p = self._at(aside)
        stream = fs.create(p, True)
        stream.write(json.dumps(value, indent=1).encode())
        stream.close()
        return aside

    def read_latest(self, path: str, default=None) -> tuple[int, object]:
        """(version, value) of the newest version of a file kept by ``write_next``; version 0 is the default."""
        held = self._versions(path)
        return (held[-1], self.read_json(f"{path}.{held[-1]:010d}")) if held else (0, default)

    def write_next(self, path: str, version: int, value, kept: int = 5) -> bool:
        """Writes version + 1; false if another writer did so first. Older versions go, but for the last few."""
        target, aside = f"{path}.{version + 1:010d}", self._written(path, value)
        done = not self.exists(target)
        if done:
            fs, p = self._at(aside)
            done = fs.rename(p, self._at(target)[1])
        if not done:
            self.delete(aside)
            return False
        for old in self._versions(path):
            if old <= version + 1 - kept:
                self.delete(f"{path}.{old:010d}")
        return True

    def _versions(self, path: str) -> list[int]:
        folder, name = path.rsplit("/", 1)
        return sorted(int(n[-10:]) for n in self.names(folder) if re.fullmatch(re.escape(name) + r"\.\d{10}", n))
