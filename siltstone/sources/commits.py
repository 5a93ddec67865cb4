"""Versioned tables in one folder: data is written first, a manifest then makes it visible all at once.

A write puts its rows under ``path/<table>/gen=<n>/try=<id>`` and publishes ``path/_manifests/<n>``, which names the folders of
all tables as they are from then on. Readers see the newest manifest, or an older one as a snapshot; folders that no manifest
names (of a write that was killed) are never read. A manifest is written beside its place and renamed, and it is only published
if its number is still free, so of two writers one fails and can repeat its write. A write that is repeated under a token which
is already published does nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TOKENS = 1000  # the newest write tokens that a manifest remembers


class Conflict(RuntimeError):
    """Another write was published in between; nothing of this one is visible."""


@dataclass(frozen=True)
class Commits:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/_manifests")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first write."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "folders": {}, "info": {}, "tokens": []}
        fs, where = self._fs(f"{self.path}/_manifests/{version:012d}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, table: str, version: int) -> str:
        """A new folder for rows of a table that ``version`` will have."""
        return f"{self.path}/{table}/gen={version}/try={uuid.uuid4().hex}"

    def publish(self, base: dict, added: dict[str, list[str]], info: dict, token: str | None = None, replace: bool = False) -> dict:
        """Makes the folders visible, together with those of ``base`` or in their place."""
        version = base["version"] + 1
        folders = {} if replace else {t: list(f) for t, f in base["folders"].items()}
        for table, paths in added.items():
            folders.setdefault(table, []).extend(p.removeprefix(f"{self.path}/") for p in paths)
        new = {"version": version, "folders": folders, "info": info, "tokens": [*base["tokens"], *([token] if token else [])][-TOKENS:]}
        fs, place = self._fs(f"{self.path}/_manifests/{version:012d}")
        _, beside = self._fs(f"{self.path}/_manifests/.{version:012d}-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise Conflict(f"version {version} of {self.path} is taken")
        return new

    def read(self, table: str, schema: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        """A table's rows; ``schema`` may name gen, and what the folders are partitioned by."""
        folders = (manifest or self.manifest(version))["folders"].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{f}" for f in folders])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the newest ``keep`` manifests don't name, older manifests too; not while others write. Returns the number
        of folders deleted."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for fs in self.manifest(v)["folders"].values() for f in fs}
        gone = 0
        for v in versions[:-keep]:
            fs, where = self._fs(f"{self.path}/_manifests/{v:012d}")
            fs.delete(where, False)
        fs, top = self._fs(self.path)
        for found in fs.globStatus(self._fs(f"{self.path}/*/gen=*/try=*")[1]) or []:
            path = found.getPath().toString()
            name = "/".join(path.split("/")[-3:])
            if name not in named:
                fs.delete(found.getPath(), True)
                gone += 1
        return gone
