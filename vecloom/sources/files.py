"""Small files and folders on any file system that Spark reads, by its own file-system calls."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.types import EngineError


def damaged(e: Exception, what: str) -> Exception:
    """``corrupt`` if a file system found by its own checksums that a file was changed; else the error itself."""
    return EngineError("corrupt", what) if "ChecksumException" in str(e) else e


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        except Exception as e:
            raise damaged(e, path) from None
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Rename over what is there: one step on file systems whose rename is one."""
        fs, p = self._at(old)
        target = self.jvm.org.apache.hadoop.fs.Path(new)
        over = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.conf).rename(fs.makeQualified(p), fs.makeQualified(target), over)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def sync(self, path: str) -> None:
        """On a mounted file system, the entries of a folder (and its files) reach the disk before this returns."""
        fs, p = self._at(path)
        p = fs.makeQualified(p).toUri()
        if p.getScheme() != "file":
            return
        folder = p.getPath()
        for x in [folder, *(os.path.join(folder, n) for n in os.listdir(folder))]:
            fd = os.open(x, os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)

    def digests(self, folders: list[str]) -> dict[str, str]:
        """One digest for the Parquet files of each folder, by the folder's name; tasks read the files."""
        found: dict[str, list[str]] = {f.rstrip("/").rpartition("/")[2]: [] for f in folders}
        try:
            rows = self._contents(folders).collect() if folders else []
        except Exception as e:
            raise damaged(e, ", ".join(found)) from None
        for r in rows:
            found[r["folder"]].append(f"{r['name']}:{r['sha']}")
        return {f: hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest() for f, x in found.items()}

    def _contents(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
        parts = F.split("path", "/")
        return rows.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("sha"))
