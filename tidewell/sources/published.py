"""Numbered records under a root, each published in one step; readers follow the newest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .ingest import FactStore


class Superseded(Exception):
    """Another writer published first, or what is to be published is older than what is."""


@dataclass(frozen=True)
class Published:
    """Records as files <number>_<label>.json. A record and all it names are complete before its file has that name."""

    spark: SparkSession
    root: str

    def at(self, name: str):
        """A path below the root and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, fs = self.at(name)
        return fs.exists(where)

    def delete(self, name: str) -> None:
        where, fs = self.at(name)
        fs.delete(where, True)

    def mark(self, name: str) -> None:
        where, fs = self.at(name)
        fs.create(where, True).close()

    def names(self) -> list[str]:
        """Names of the published records, oldest first."""
        where, fs = self.at("published")
        found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in found if n.endswith(".json") and n[0].isdigit())

    def newest(self) -> str | None:
        return (self.names() or [None])[-1]

    def load(self, name: str) -> dict:
        """The record of a name below ``published``."""
        return self.get(f"published/{name}")

    def get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    def put(self, name: str, record: dict) -> None:
        """Write a record aside and rename it, so that it is never seen in part."""
        aside, fs = self.at(f"_writing/{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(json.dumps(record).encode())
        out.close()
        where, _ = self.at(name)
        fs.mkdirs(where.getParent())
        if not fs.rename(aside, where):
            raise Superseded(f"{name} is there")

    def commit(self, record: dict, label: str, after: str | None) -> str:
        """Publish ``record`` as the one after ``after`` (None: as the first); raises if that isn't the newest any more."""
        with FactStore(self.spark, self.root).locked("all", "published"):
            if self.newest() != after:
                raise Superseded(f"{self.newest()} was published after {after}")
            name = f"{int(after.partition('_')[0]) + 1 if after else 0:010d}_{label}.json"
            self.put(f"published/{name}", record)
        return name
