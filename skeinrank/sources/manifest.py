"""Versioned manifests: small JSON documents that say which files of a folder are live.

A change is one new manifest, written under a hidden name and renamed to its version.  The rename fails if that version
is there, so of two writers that started from the same version one gets :class:`Conflict`.  Readers take the newest
version; files that only older versions name can be removed after a grace period.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


class Folder:
    """A folder in any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.at("").getFileSystem(self._conf)

    def at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Entries that aren't hidden, sorted."""
        if not self.exists(name):
            return []
        found = (x.getPath().getName() for x in self._fs.listStatus(self.at(name)))
        return sorted(x for x in found if not x.startswith((".", "_")))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0

    def modified(self, name: str) -> float:
        """Seconds since the epoch."""
        return self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self.at(name), True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> bool:
        """Rename unless the new name is taken."""
        context = self._hadoop.FileContext.getFileContext(self.at("").toUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark._sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(context.makeQualified(self.at(old)), context.makeQualified(self.at(new)), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


class Manifest:
    """The manifests of a folder, in its subfolder ``manifests``."""

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def read(self) -> dict | None:
        """The newest one, with its ``version``; None if there is none."""
        names = self.folder.names("manifests")
        return json.loads(self.folder.read(f"manifests/{names[-1]}")) if names else None

    def commit(self, content: dict) -> dict:
        """The successor of the version that ``content`` was read from (0 or absent: the first)."""
        content = content | {"version": content.get("version", 0) + 1}
        name = f"manifests/{content['version']:012d}.json"
        hidden = f"manifests/.{uuid.uuid4().hex}"
        self.folder.write(hidden, json.dumps(content).encode())
        if not self.folder.rename_new(hidden, name):
            self.folder.delete(hidden)
            raise Conflict(f"version {content['version']} of {self.folder.path} is another writer's")
        return content

    def prune(self, keep: int = 20) -> None:
        for name in self.folder.names("manifests")[:-keep]:
            self.folder.delete(f"manifests/{name}")
