"""Small files with put-if-absent, the primitive under every commit.

Paths without a scheme or with ``file:`` use the operating system; all others go through the
Hadoop file system that Spark has for them, whose rename must not replace a file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def local_path(uri: str) -> str | None:
    """The path on this machine's file system, None for other stores."""
    parts = urlparse(uri)
    if parts.scheme == "":
        return uri
    return unquote(parts.path) if parts.scheme == "file" else None


class LocalStore:
    """Files of a folder that all drivers of a table can reach."""

    def put_if_absent(self, path: str, data: bytes) -> bool:
        """Write a whole file, or return False if one is there."""
        folder = os.path.dirname(path)
        os.makedirs(folder, exist_ok=True)
        handle, temp = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.link(temp, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)

    def replace(self, path: str, data: bytes) -> None:
        """Write a whole file in the place of whatever is there."""
        folder = os.path.dirname(os.path.abspath(path))
        os.makedirs(folder, exist_ok=True)
        handle, temp = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=folder)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temp, path)

    def read(self, path: str) -> bytes | None:
        try:
            return Path(path).read_bytes()
        except FileNotFoundError:
            return None

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
        except FileNotFoundError:
            return []


class HadoopStore:
    """The same through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def _beside(self, files, path: str, data: bytes):
        """A new file in the folder of ``path``."""
        _, temp = self._fs(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
        out = files.create(temp, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return temp

    def replace(self, path: str, data: bytes) -> None:
        files, target = self._fs(path)
        temp = self._beside(files, path, data)
        jvm = self.spark.sparkContext._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, target, how)

    def put_if_absent(self, path: str, data: bytes) -> bool:
        files, target = self._fs(path)
        if files.exists(target):
            return False
        temp = self._beside(files, path, data)
        done = files.rename(temp, target)
        if not done:
            files.delete(temp, False)
        return done

    def read(self, path: str) -> bytes | None:
        files, target = self._fs(path)
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        files, target = self._fs(folder)
        if not files.exists(target):
            return []
        found = (s.getPath().getName() for s in files.listStatus(target))
        return sorted(n for n in found if not n.startswith((".", "_")))


def store_for(spark: SparkSession, uri: str) -> tuple[LocalStore | HadoopStore, str]:
    """The store of a URI, and the path to use with it."""
    path = local_path(uri)
    return (LocalStore(), path) if path is not None else (HadoopStore(spark), uri)
