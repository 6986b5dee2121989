"""Versioned tables: folders of Parquet with a manifest for each version (one writer at a time)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Versions of a table. A version is a list of data folders; appends add one, overwrites replace them.

    Manifests are small files written through Spark's file system, so any store that
    Spark can write to will do.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.at = spark, path.rstrip("/"), version

    # -- files
    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _put(self, name: str, value) -> None:
        fs, where = self._fs(name)
        out = fs.create(where, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def _get(self, name: str):
        fs, where = self._fs(name)
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    # -- versions
    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("_manifests") if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The version that is checked out, or the newest."""
        if self.at is not None:
            return self.at
        found = self.versions()
        return found[-1] if found else 0

    def latest(self) -> VersionedTable:
        return VersionedTable(self.spark, self.path)

    def checkout(self, version: int | str) -> VersionedTable:
        """The table as of a version or a tag."""
        v = self.tags()[version] if isinstance(version, str) else version
        if v not in self.versions():
            raise ValueError(f"no version {v}")
        return VersionedTable(self.spark, self.path, v)

    def restore(self, version: int) -> int:
        """Make an old version the newest again."""
        return self._commit(self._get(f"_manifests/v{version:010d}.json")["folders"], "restore")

    def repair(self) -> int:
        """Restore the newest version that can be read; returns it."""
        for v in reversed(self.versions()):
            try:
                self.checkout(v).read().count()
            except Exception:  # noqa: BLE001 - whatever makes it unreadable
                continue
            if v != self.versions()[-1]:
                self.restore(v)
            return v
        raise ValueError("no version can be read")

    def tags(self) -> dict[str, int]:
        return self._get("_tags.json") if self._fs("_tags.json")[0].exists(self._fs("_tags.json")[1]) else {}

    def tag(self, name: str, version: int | None = None) -> None:
        self._put("_tags.json", self.tags() | {name: version or self.version()})

    def untag(self, name: str) -> None:
        self._put("_tags.json", {k: v for k, v in self.tags().items() if k != name})

    def cleanup(self, keep: int = 1) -> list[int]:
        """Drop all but the newest versions and those with tags, and the folders that none of the rest uses."""
        every, tagged = self.versions(), set(self.tags().values())
        gone = [v for v in every[:-keep] if v not in tagged]
        used = {f for v in every if v not in gone for f in self._get(f"_manifests/v{v:010d}.json")["folders"]}
        for v in gone:
            fs, where = self._fs(f"_manifests/v{v:010d}.json")
            fs.delete(where, False)
        for f in self._names("data"):
            if f"data/{f}" not in used:
                fs, where = self._fs(f"data/{f}")
                fs.delete(where, True)
        return gone

    def _commit(self, folders: list[str], operation: str) -> int:
        v = (self.versions() or [0])[-1] + 1
        self._put(f"_manifests/v{v:010d}.json", {"version": v, "operation": operation, "folders": folders})
        return v

    def history(self) -> list[tuple[int, str]]:
        return [(v, self._get(f"_manifests/v{v:010d}.json")["operation"]) for v in self.versions()]

    # -- rows
    def read(self) -> DataFrame:
        folders = self._get(f"_manifests/v{self.version():010d}.json")["folders"]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def write(self, df: DataFrame, mode: str = "append", rows_per_file: int | None = None, operation: str | None = None) -> int:
        """append, overwrite, or create (fails where versions exist); returns the new version."""
        have = self.versions()
        if mode == "create" and have:
            raise ValueError("the table exists")
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write if rows_per_file is None else df.write.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{self.path}/{folder}")
        old = self._get(f"_manifests/v{have[-1]:010d}.json")["folders"] if have and mode == "append" else []
        return self._commit([*old, folder], operation or mode)

    def count_rows(self, condition: str | None = None) -> int:
        df = self.read()
        return (df if condition is None else df.where(condition)).count()

    def compact(self, rows_per_file: int = 1 << 20) -> int:
        """Rewrite the newest version into files of about so many rows."""
        df = self.read()
        n = max(1, -(-df.count() // rows_per_file))
        return self.write(df.repartition(n), "overwrite", rows_per_file, "compact")

    def delete(self, condition: str) -> int:
        """Rows for which the condition is not true stay (null counts as not)."""
        return self.write(self.read().where(~F.coalesce(F.expr(condition), F.lit(False))), "overwrite", operation="delete")

    def update(self, values: dict[str, str], where: str | None = None) -> int:
        df = self.read()
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        new = df.select(*[F.when(hit, F.expr(values[c])).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])
        return self.write(new, "overwrite", operation="update")

    def merge_insert(self, source: DataFrame, on: list[str], **how) -> int:
        from ..operators.tables import merge_insert

        return self.write(merge_insert(self.read(), source, on, **how), "overwrite", operation="merge")
