"""Tables that change: Parquet in hash buckets with one small manifest per version.

A commit writes the buckets that its batch touches into a new folder and then, as its last step, puts the next manifest in place by a rename that fails if the name is taken. Readers
take the newest manifest and read the files that it names; those never change, so a reader keeps its version whatever is committed meanwhile, and a writer that dies before the
rename leaves nothing but an unread folder. Work and writing grow with the touched buckets, not with the table.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: From what touched buckets hold and the rows of a batch (both with the table's columns; the batch may have more) to what they hold afterwards.
Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "__bucket"


class Conflict(Exception):
    """Another commit took the version."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marketweave-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/marketweave-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder that all executors see, and read from it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Snapshot:
    """One version: the folder of each bucket that has rows, and what the commit that made it counted."""

    version: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str]
    counts: dict[str, int] = field(default_factory=dict)
    #: Of each writer that numbers its batches, the last one.
    batches: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """Hadoop's file context for path, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    files, path = _files(spark, folder)
    if not files.util().exists(path(folder)):
        return []
    return sorted(x.getPath().getName() for x in files.util().listStatus(path(folder)))


def _put(spark: SparkSession, folder: str, snapshot: Snapshot) -> None:
    """The snapshot's manifest under its final name, whole or not at all."""
    jvm = spark.sparkContext._jvm
    files, path = _files(spark, folder)
    draft, final = f"{folder}/draft-{uuid.uuid4().hex}", f"{folder}/{snapshot.version:020d}.json"
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    out = files.create(path(draft), flags, options)
    out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
    out.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(path(draft), path(final), renames)
    except Exception as e:
        files.delete(path(draft), False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {snapshot.version} of {folder} is taken") from e
        raise


def _seen(counted: Observation, otherwise: Callable[[], int]) -> int:
    """What a job counted on its way; otherwise() where the optimiser left the counting out, as it knew that no row comes there or that none is needed."""
    try:
        return counted.get["n"]
    except Py4JError:
        return otherwise()


class Table:
    """A stored table under a folder. Rows are dealt to buckets by a hash of keys; what a merge looks at together must share its keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64) -> Table:
        """An empty table. A bucket is rewritten as a whole, so it should hold some 100 MB."""
        made = cls(spark, path)
        _put(spark, f"{made.path}/manifests", Snapshot(0, schema.json(), list(keys), buckets, {}))
        return made

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in _names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one named."""
        number = max(self.versions()) if version is None else version
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{number:020d}.json").collect())
        return Snapshot(**json.loads(text))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; later commits don't change them."""
        return self._rows(self.snapshot(version))

    def _rows(self, at: Snapshot, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(at.schema))
        folders = [f"{self.path}/{f}" for b, f in at.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def changed(self, since: int, version: int | None = None) -> DataFrame:
        """Rows of a version in buckets that were written after the version since; files that both share are not read."""
        old, new = self.snapshot(since), self.snapshot(version)
        return self._rows(new, [b for b, f in new.folders.items() if old.folders.get(b) != f])

    def history(self) -> DataFrame:
        """version, offered, inserted and skipped (rows that made no row of their own) of the versions that are kept."""
        folder = f"{self.path}/manifests/*.json"
        counts = self.spark.read.schema("version long, counts struct<offered:bigint,before:bigint,after:bigint>").json(folder)
        n = lambda c: F.coalesce(F.col(f"counts.{c}"), F.lit(0))
        return counts.select("version", n("offered").alias("offered"), (n("after") - n("before")).alias("inserted"), (n("offered") - n("after") + n("before")).alias("skipped"))

    def commit(self, batch: DataFrame, merge: Merge, writer: str | None = None, number: int | None = None, attempts: int = 3) -> Snapshot:
        """Merges a batch and returns the new version, whose counts are offered (rows of the batch), before and after (rows of the touched buckets).

        All are counted by the jobs that write anyway. A writer that numbers its batches may offer one again: what it committed already is left out. Commits of others in between are
        kept: if they touched other buckets, only the manifest is made anew, else the merge is.
        """
        base = self.snapshot()
        if writer is not None and base.batches.get(writer, -1) >= number:
            return base
        offered, staged = Observation(), f"{self.path}/staged/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*base.keys), F.lit(base.buckets))
        batch.withColumn(BUCKET, bucket).observe(offered, F.count(F.lit(1)).alias("n")).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        touched = [str(r[BUCKET]) for r in rows.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
        try:
            for _ in range(attempts):
                written = self._merged(base, rows, touched, merge)
                while True:
                    counts = {"offered": _seen(offered, lambda: 0), **written[1]}
                    folders = {b: f for b, f in base.folders.items() if b not in touched} | written[0]
                    new = Snapshot(base.version + 1, base.schema, base.keys, base.buckets, folders, counts, base.batches | ({writer: number} if writer is not None else {}))
                    try:
                        _put(self.spark, f"{self.path}/manifests", new)
                        return new
                    except Conflict:
                        now = self.snapshot()
                        if writer is not None and now.batches.get(writer, -1) >= number:
                            return now
                        same = all(now.folders.get(b) == base.folders.get(b) for b in touched)
                        base = now
                        if not same:
                            break
            raise Conflict(f"{attempts} merges into {self.path} met commits of others")
        finally:
            self._delete(staged)

    def _merged(self, base: Snapshot, rows: DataFrame, touched: list[str], merge: Merge) -> tuple[dict[str, str], dict[str, int]]:
        """New folders of touched buckets that have rows, and the rows before and after."""
        if not touched:
            return {}, {"before": 0, "after": 0}
        columns = StructType.fromJson(json.loads(base.schema)).names
        before, after, folder = Observation(), Observation(), f"data/{uuid.uuid4().hex}"
        old = self._rows(base, touched)
        had_rows = any(b in base.folders for b in touched)
        seen = old.observe(before, F.count(F.lit(1)).alias("n")) if had_rows else old
        done = merge(seen, rows.drop(BUCKET)).select(*columns).withColumn(BUCKET, F.pmod(F.xxhash64(*base.keys), F.lit(base.buckets)))
        done.observe(after, F.count(F.lit(1)).alias("n")).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made = {n.split("=")[1]: f"{folder}/{n}" for n in _names(self.spark, f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")}
        return made, {"before": _seen(before, old.count) if had_rows else 0, "after": _seen(after, lambda: 0)}

    def _delete(self, folder: str) -> None:
        files, path = _files(self.spark, folder)
        files.delete(path(folder), True)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last keep versions names, with the older manifests, and tells how many. Not while commits run: theirs are named by none yet."""
        versions = self.versions()
        named = {f.split("/")[1] for v in versions[-keep:] for f in self.snapshot(v).folders.values()}
        gone = [f"data/{n}" for n in _names(self.spark, f"{self.path}/data") if n not in named] + [f"manifests/{v:020d}.json" for v in versions[:-keep]]
        for name in gone:
            self._delete(f"{self.path}/{name}")
        return len(gone)
