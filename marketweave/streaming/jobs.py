"""News items as a stream: shaping, duplicates, mapping per micro-batch, and price corrections."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions import text as t
from ..operators import sinks
from ..operators.stored import Conflict, Table


def feed_items(raw: DataFrame) -> DataFrame:
    """Items with title and address from raw feed rows (item_id, title, snippet, link, published, updated): one date, hashes of address and content. Works on streams and tables."""
    when = F.coalesce("published", "updated")
    kept = raw.where((t.compact(F.col("title")) != "") & (t.compact(F.col("link")) != ""))
    return kept.select("item_id", t.compact(F.col("title")).alias("title"), t.compact(F.col("snippet")).alias("snippet"), F.col("link").alias("url"), when.alias("published_at"), t.url_hash(F.col("link")).alias("url_hash"), t.content_hash(t.compact(F.col("title")), t.compact(F.col("snippet"))).alias("content_hash"))


def first_per_url(items: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The first item of each address. State is kept for lateness: an address that returns later counts as new, which a table never does."""
    return items.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["url_hash"])


class _LastItem(StatefulProcessor):
    """Per content hash, the item seen last; forgotten when the watermark is remembered_ms beyond it."""

    def __init__(self, remembered_ms: int):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "item_id long, until_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = sorted((x["at_ms"] is None, x["at_ms"] or 0, x["item_id"]) for x in rows)
        before, until = self.last.get() or (None, 0)  # each call costs a trip to the state store
        dated = [at for undated, at, _ in found if not undated]
        at = dated[-1] if dated else timerValues.getCurrentWatermarkInMs()  # items without a date count as of the watermark
        until = max(until, at + self.remembered_ms)
        self.last.update((found[-1][2], until))
        self.handle.registerTimer(until)
        for _, _, item in found:
            yield Row(item_id=item, content_hash=key[0], duplicate_of=before, status="new" if before is None else "skipped")
            before = item

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def mark_duplicates(items: DataFrame, remembered_days: float = 30, lateness: str = "7 days") -> DataFrame:
    """item_id, content_hash, duplicate_of (the item of the same content that came before), status. Items without a date come last in their batch.

    A content that did not return within remembered_days (by published_at, behind a watermark of lateness) is forgotten, so state is bounded; a table never forgets.
    """
    schema = "item_id long, content_hash string, duplicate_of long, status string"
    shaped = items.withWatermark("published_at", lateness).select("item_id", "content_hash", "published_at", F.unix_millis("published_at").alias("at_ms"))
    return shaped.groupBy("content_hash").transformWithState(_LastItem(int(remembered_days * 86_400_000)), schema, "Append", "EventTime")


#: What tells in an error that storage or machines failed, not the work.
NOT_THE_WORK = ("java.io.", "FileNotFound", "No space left", "OutOfMemory", "ExecutorLost", "MetadataFetchFailed", "FetchFailed")


def per_batch(stream: DataFrame, target: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str, keep: list[str] | None = None) -> DataStreamWriter:
    """Applies work to each micro-batch and writes the result under target by batch number. A batch that is run again replaces its own output, so a restart repeats nothing.

    With keep, a batch whose work fails doesn't stop the stream: its rows are written with these columns, status error and the message in error, for failed() to read. Errors of storage
    or machines are raised, as the same batch may succeed later. Work is evaluated once.
    """

    def run(batch: DataFrame, number: int) -> None:
        to = f"{target}/batch={number}"
        none = F.lit(None).cast("string").alias("error")
        try:
            done = work(batch)
            (done if keep is None else done.select(*keep, "status", none)).dropDuplicates(keys).write.mode("overwrite").parquet(to)
        except Exception as e:
            said = str(e)
            if keep is None or any(x in said for x in NOT_THE_WORK):
                raise
            logging.getLogger(__name__).warning("batch %s is marked as failed: %s", number, said.splitlines()[0] if said else type(e).__name__)
            batch.select(*keep).withColumns({"status": F.lit("error"), "error": F.lit((said or type(e).__name__)[:500])}).dropDuplicates(keys).write.mode("overwrite").parquet(to)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def failed(spark: SparkSession, target: str) -> DataFrame:
    """Rows that per_batch marked as failed, with the message and the batch, for another attempt."""
    return spark.read.parquet(target).where("status = 'error'")


def commits(stream: DataFrame, table: Table, merge: sinks.Merge, checkpoint: str) -> DataStreamWriter:
    """Merges each micro-batch into a stored table. The table remembers the last batch of this checkpoint, so a batch that is run again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        table.commit(batch, merge, checkpoint, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _table(stream: DataFrame, target: str, keys: list[str], buckets: int) -> Table:
    """The table under target; it is made if it isn't there."""
    table = Table(stream.sparkSession, target)
    if not table.versions():
        try:
            return Table.create(stream.sparkSession, target, stream.schema, keys, buckets)
        except Conflict:  # another job made it just now
            pass
    return table


def first_items(items: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Keeps under target, as a stored table, the first item (by published_at, then item_id) of each address ever met, whenever it comes back and in whatever order batches come.

    Each batch meets only the buckets of its addresses. Items without a date come after those with one.
    """
    when = F.coalesce(F.col("published_at"), F.lit("9999-12-31").cast("timestamp"))
    shaped = items.withColumn("first_at", when)
    return commits(shaped, _table(shaped, target, ["url_hash"], buckets), sinks.firsts(["url_hash"], ["first_at", "item_id"]), checkpoint)


BAR = ["stock_code", "trade_date"]


def bars(spark: SparkSession, target: str) -> DataFrame:
    """The table that upsert_bars keeps under target: of each bar the latest version."""
    return Table(spark, target).read().drop("trade_month")


def upsert_bars(stream: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Late corrections (stock_code, trade_date, close, version) overwrite earlier bars of a stored table; bars() reads it.

    Buckets are dealt by stock and month, so a batch rewrites the buckets of the months that it corrects.
    """
    monthly = stream.withColumn("trade_month", F.trunc("trade_date", "month"))
    return commits(monthly, _table(monthly, target, ["stock_code", "trade_month"], buckets), sinks.lasts(BAR, ["version"]), checkpoint)
