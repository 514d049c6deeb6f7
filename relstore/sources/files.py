"""Files of a database folder: local ones with fsync, others through Hadoop's file system."""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession


def plain(path: str) -> str:
    """One spelling of a path, so that those from Spark and from the manifest can be compared."""
    path = unquote(path)
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


class Store:
    def __init__(self, root: str, spark: SparkSession):
        self.root, self.spark = plain(root).rstrip("/"), spark
        self.local = "://" not in self.root
        if self.local:
            self.root = os.path.abspath(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, name: str) -> bytes | None:
        if self.local:
            try:
                with open(self.path(name), "rb") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        fs, p = self._fs(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """The file has its new content as a whole, durably, or is as before."""
        if self.local:
            part = self.path(f".{name}.{uuid.uuid4().hex}")
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, self.path(name))
            self._sync(self.root)
            return
        fs, p = self._fs(f".{name}.{uuid.uuid4().hex}")
        stream = fs.create(p, True)
        stream.write(bytearray(data))
        stream.hsync()
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        rename = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = overwrite
        context.rename(p, self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), rename)

    @staticmethod
    def _sync(path: str) -> None:
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def sync(self, paths: list[str]) -> None:
        """Local data files reach the disk before a manifest names them; other stores do so on close."""
        if self.local:
            folders = set()
            for p in paths:
                self._sync(plain(p))
                folders.add(os.path.dirname(plain(p)))
            for p in folders:
                self._sync(p)

    def list(self, name: str) -> list[str]:
        """Names of what lies in a folder, as paths from the root."""
        prefix = name + "/" if name else ""
        if self.local:
            try:
                return sorted(prefix + x for x in os.listdir(self.path(name)))
            except (FileNotFoundError, NotADirectoryError):
                return []
        fs, p = self._fs(name)
        return sorted(prefix + s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        if self.local:
            if os.path.isdir(self.path(name)):
                shutil.rmtree(self.path(name), ignore_errors=True)
            elif os.path.exists(self.path(name)):
                os.remove(self.path(name))
            return
        fs, p = self._fs(name)
        fs.delete(p, True)
