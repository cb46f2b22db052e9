"""Immutable shards of documents under size-tiered compaction, with a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, shared_dir

TARGET_BYTES = 32 << 20
#: Tiers part at TARGET_BYTES / FANOUT, TARGET_BYTES / FANOUT ** 2 and so on; that many shards of a tier start a merge.
FANOUT = 4
#: Rows of a shard as it arrives, so that arrivals come in small pieces whatever the size of the tasks that read them.
ARRIVAL_ROWS = 4096


@dataclass(frozen=True)
class Shard:
    """One Parquet file, never changed once written. ``run`` is the append or merge that wrote it."""

    path: str
    bytes: int
    run: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    shards: list[Shard] = field(default_factory=list)


#: Versions that an append goes after before it gives up.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Shards under one folder that all executors reach, and manifests that say which of them are live.

    Readers take the newest manifest, so they see a whole version or the one
    before. A commit writes the manifest aside and gives it its version's name
    in one step that refuses a name that is taken: a hard link on a local file
    system, a rename elsewhere, which HDFS refuses. Stores whose rename
    overwrites or copies need one writer at a time. Files of a failed or lost
    attempt are in no manifest and go with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target = spark, root, target_bytes
        jvm = spark._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.Path(root))

    def files(self, folder: str) -> list[tuple[str, int]]:
        path = self.Path(f"{self.root}/{folder}")
        if not self.fs.exists(path):
            return []
        return sorted((f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(path))

    def manifest(self) -> Manifest:
        names = [n for n, _ in self.files(".") if n.startswith("manifest-") and n.endswith(".json")]
        if not names:
            return Manifest()
        stream = self.fs.open(self.Path(f"{self.root}/{max(names)}"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(raw["version"], [Shard(**s) for s in raw["shards"]])

    def commit(self, based_on: Manifest, shards: list[Shard]) -> Manifest:
        """Make ``shards`` the next version after ``based_on``, or raise Conflict: if that is taken, or if files of ``shards`` are gone, as after a vacuum."""
        held = {s.path for s in based_on.shards}
        for folder in sorted({s.path.partition("/")[0] for s in shards if s.path not in held and s.path.startswith("data-")}):
            there = {f"{folder}/{n}" for n, _ in self.files(folder)}
            if any(s.path not in there for s in shards if s.path.startswith(f"{folder}/")):
                raise Conflict(f"files of {folder} are gone")
        new = Manifest(based_on.version + 1, shards)
        name, aside = f"manifest-{new.version:010d}.json", self.Path(f"{self.root}/.aside-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(json.dumps(asdict(new)).encode())
        stream.close()
        try:
            if not self.named(aside, self.Path(f"{self.root}/{name}")):
                raise Conflict(name)
        finally:
            self.fs.delete(aside, False)
        return new

    def named(self, aside, final) -> bool:
        """Give a file its final name, or False if that is taken."""
        if self.fs.getUri().getScheme() != "file":
            return not self.fs.exists(final) and self.fs.rename(aside, final)
        jvm = self.spark._jvm
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(final), local(aside))
        except Py4JJavaError as err:
            if "FileAlreadyExistsException" in str(err.java_exception):
                return False
            raise
        return True

    def written(self, df: DataFrame, run: int, most_rows: int = 0) -> list[Shard]:
        """Write each partition of ``df`` as a shard, or several of at most ``most_rows`` rows; empty ones give none (an empty table is written as one empty file)."""
        folder = f"data-{run:010d}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(f"{self.root}/{folder}")
        files = [(n, size) for n, size in self.files(folder) if n.endswith(".parquet")]
        if len(files) == 1 and self.spark.read.parquet(f"{self.root}/{folder}/{files[0][0]}").isEmpty():
            return []
        return [Shard(f"{folder}/{n}", size, run) for n, size in files]

    def rows(self, shards: list[Shard]) -> DataFrame:
        """row (a struct of the columns as written) and the name of the file it lies in."""
        found = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])
        return found.select(F.struct(*map(quoted, found.columns)).alias("row"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard_file"))

    def append(self, arrivals: DataFrame) -> Manifest:
        """Add ``arrivals`` as small shards, written by the tasks that read them, without a shuffle.

        Where another writer was first, they are added to its version; where
        their files are gone, they are written again.
        """
        new: list[Shard] | None = None
        for left in reversed(range(TRIES)):
            base = self.manifest()
            if new is None or any(not self.fs.exists(self.Path(f"{self.root}/{s.path}")) for s in new):
                new = self.written(arrivals, base.version + 1, ARRIVAL_ROWS)
            try:
                return self.commit(base, base.shards + new)
            except Conflict:
                if not left:
                    raise

    def tier(self, size: int) -> int:
        """0 for shards of target size, one more for each factor of FANOUT below it."""
        t = 0
        while size * FANOUT ** (t + 1) <= self.target and t < 20:
            t += 1
        return t

    def groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards to merge, each up to target size."""
        found: list[list[Shard]] = []
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes <= self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        for members in tiers.values():
            if len(members) < FANOUT:
                continue
            group: list[Shard] = []
            for s in members:
                if group and sum(x.bytes for x in group) + s.bytes > self.target:
                    found.append(group)
                    group = []
                group.append(s)
            found.append(group)
        return [g for g in found if len(g) > 1]

    def compact(self) -> Manifest:
        """Merge until no tier holds FANOUT shards that could be merged; each round commits a version."""
        base = self.manifest()
        while groups := self.groups(base.shards):
            into = {s.path: i for i, g in enumerate(groups) for s in g}
            # One row per shard to merge: the manifest's own size, not the data's.
            table = self.spark.createDataFrame([(p.rpartition("/")[2], i) for p, i in into.items()], "shard_file string, into int")
            placed = self.rows([s for g in groups for s in g]).join(F.broadcast(table), "shard_file")
            # By number and not by hash, so that each group is one partition and one file.
            merged = placed.repartitionById(len(groups), "into").select("row.*")
            new = self.written(merged, base.version + 1)
            base = self.commit(base, [s for s in base.shards if s.path not in into] + new)
        return base

    def vacuum(self, grace_ms: int = 0) -> None:
        """Delete files that the newest manifest does not name and that are older than ``grace_ms``.

        With no grace, files of a writer that has not committed go too; its
        commit then raises Conflict. Where others write, give a grace longer
        than a write takes, as readers of earlier versions need it as well.
        """
        latest = time.time() * 1000 - grace_ms
        live = {s.path for s in self.manifest().shards}
        for folder, _ in self.files("."):
            if folder.startswith("data-") and (not grace_ms or self.fs.getFileStatus(self.Path(f"{self.root}/{folder}")).getModificationTime() <= latest):
                gone = [n for n, _ in self.files(folder) if f"{folder}/{n}" not in live]
                if len(gone) == len(self.files(folder)):
                    self.fs.delete(self.Path(f"{self.root}/{folder}"), True)
                else:
                    for n in gone:
                        self.fs.delete(self.Path(f"{self.root}/{folder}/{n}"), False)

    def read(self) -> DataFrame | None:
        """row (a struct) with its shard: number in the manifest, file, bytes and tier; None if there is no shard."""
        now = self.manifest()
        if not now.shards:
            return None
        table = self.spark.createDataFrame(
            [(s.path.rpartition("/")[2], i, s.bytes, self.tier(s.bytes), now.version) for i, s in enumerate(now.shards)],
            "shard_file string, shard_id int, shard_bytes long, shard_tier int, manifest_version int",
        )
        return self.rows(now.shards).join(F.broadcast(table), "shard_file")


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES, root: str | None = None) -> DataFrame:
    """Append ``docs`` to a new store, compact it, and return doc_id with the shard each row lies in.

    Returns doc_id, shard_id, shard_file, shard_bytes, shard_tier and
    manifest_version, one row per input row, nulls and repeats included; an
    empty table gives no rows. Columns keep their names and values in the
    shards. Shards in the last version are near target size, but for what is
    left of each tier with fewer than FANOUT members. A merge takes shards of
    together at most the target, so it can pass it only by what Parquet packs
    worse in one file than in several; an arrival passes it only if
    ARRIVAL_ROWS very long texts do, and is then never merged or cut.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs)
    store.compact()
    store.vacuum()
    fields = ("shard_id", "shard_file", "shard_bytes", "shard_tier", "manifest_version")
    placed = store.read()
    if placed is None:
        empty = "shard_id int, shard_file string, shard_bytes long, shard_tier int, manifest_version int"
        return docs.select("doc_id").limit(0).join(spark.createDataFrame([], empty), F.lit(True), "inner").select("doc_id", *fields)
    return placed.select("row.doc_id", *fields)
