"""Folders of versions: each is a JSON entry that is created exclusively, and names what it consists of."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed the next version."""


class Versioned:
    """A folder on any file system that Spark writes to, with ``_log/<n>.json`` for its version n."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _json(self, name: str):
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, name: str, value) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        stream.write(json.dumps(value).encode())
        stream.close()

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, version: int) -> dict:
        """What a version consists of."""
        return self._json(f"_log/{version}.json")

    def publish(self, version: int, entry: dict) -> None:
        """Make the version known, unless there is one of this number."""
        try:
            self._put(f"_log/{version}.json", entry)
        except Exception as error:
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {version} exists") from error
            raise
