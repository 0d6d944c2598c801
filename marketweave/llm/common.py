"""What the operators of this folder share: storage all executors see, checked broadcasts, keys that may be null."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return qualified(spark, base).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="marketweave-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark understands it: a path without scheme lies in the cluster's default file system, which Python workers don't know."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def arrow_uri(path: str) -> str:
    """A qualified path as Arrow writes it; s3a and s3n are its s3. Raises ValueError for a path without scheme, which would be another folder on each machine."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} names no file system: give its scheme, such as hdfs:// or file://")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    return f"{scheme}:{quote('//' + '/' + rest.lstrip('/') if scheme == 'file' else rest, safe='/:@?&=%+')}"


def arrow_fs(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it, for Python workers. Raises ValueError for schemes that Arrow doesn't know."""
    uri = arrow_uri(path)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.partition(":")[2].lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"Python workers cannot reach {path}: use a folder in hdfs, viewfs, s3a, gs, abfss or a shared file:// path") from e


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. :func:`forget` removes what was made, at the latest when the driver's Python ends."""
    path = f"{shared_dir(spark)}/marketweave-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(forget)
    _made.append((spark, path))
    return path


def forget() -> None:
    """Deletes every scratch table; frames that still read them fail afterwards."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            continue


def narrow_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on, the session hands Python workers at most about size bytes at once (one row at least): whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df (a stored or otherwise cheap table) with a broadcast hint if it has at most max_rows rows, else unchanged: Spark shuffles then."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys in which null equals null. The result has left's columns, then right's without the keys."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(r[f"__{k}"])
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_bytes: int) -> DataFrame:
    """Whole texts (text) and labels (y) of a bounded sample: of rows that satisfy train, at most per_class of each label and max_bytes in all.

    Rows are taken in the order of a hash of doc_id, so the sample depends on neither partitions nor their order. A doc_id with
    several labels counts with the largest, one with several texts with the shortest (of equal ones that with the smallest hash). Sizes are added up before any text is moved, so
    the bound holds for what is shuffled, too; it does not grow with the corpus.
    """
    from pyspark.sql import Window

    y = F.col(label).cast("int")
    known = labels.select("doc_id", y.alias("y")).where(y.isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    mine = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(pick), "doc_id")
    sized = mine.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"))).alias("s")).select("doc_id", "s.*")
    total = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = sized.withColumn("total", total).where(F.col("total") <= max_bytes).select(F.col("doc_id").alias("id"), "h")
    return mine.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
