"""Rows that arrive in batches and are read by period or by arrival.

A batch is a folder that is never changed; inside, rows lie in a folder for each period and are sorted by time, so a range of time reads the folders of its periods alone and skips
groups of rows by their statistics, and a reader that keeps a mark reads the folders of new batches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from ..operators.stored import _files, _names

BATCH, PERIOD = "batch", "period"


class PeriodLog:
    """A log under a folder: rows with a column of dates or timestamps, when, by periods of a unit that trunc() knows (day, week, month, quarter, year)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, when: str, unit: str = "month"):
        self.spark, self.path, self.schema, self.when, self.unit = spark, path.rstrip("/"), schema, when, unit

    def _period(self, when: Column) -> Column:
        return F.to_date(when) if self.unit == "day" else F.trunc(F.to_date(when), self.unit)

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole, ascending."""
        return sorted(int(n.split("=")[1]) for n in _names(self.spark, f"{self.path}/data") if n.startswith(f"{BATCH}="))

    def append(self, rows: DataFrame, number: int | None = None) -> int:
        """Writes a batch and returns its number. One that is there already is left as it is, so a batch may be offered again. Rows without a time lie in a period of their own."""
        have = self.batches()
        number = (have[-1] + 1 if have else 0) if number is None else number
        if number in have:
            return number
        # By ranges of time, so that a large period is the work of several tasks.
        dealt = rows.select(*self.schema.names).withColumn(PERIOD, self._period(F.col(self.when))).repartitionByRange(PERIOD, self.when).sortWithinPartitions(PERIOD, self.when)
        draft = f"{self.path}/drafts/{BATCH}={number}"
        dealt.write.mode("overwrite").partitionBy(PERIOD).parquet(draft)
        files, path = _files(self.spark, self.path)
        files.mkdir(path(f"{self.path}/data"), None, True)
        files.rename(path(draft), path(f"{self.path}/data/{BATCH}={number}"), self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return number

    def _read(self, numbers: list[int]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BATCH, IntegerType()), StructField(PERIOD, DateType())])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{BATCH}={n}" for n in numbers])

    def read(self) -> DataFrame:
        """All rows, with batch and period."""
        return self._read(self.batches())

    def between(self, first: Column, last: Column) -> DataFrame:
        """Rows with first <= when <= last (of the column's type) by the folders of their periods."""
        return self.read().where(F.col(PERIOD).between(self._period(first), self._period(last)) & F.col(self.when).between(first, last))

    def mark(self, reader: str) -> int:
        """The last batch that a reader is done with; -1 if there is none."""
        return max((int(n) for n in _names(self.spark, f"{self.path}/marks/{reader}")), default=-1)

    def new_rows(self, reader: str, work: Callable[[DataFrame], None], period: Column | None = None) -> int:
        """Does work on the rows of batches beyond the reader's mark, and then moves the mark; returns the mark. If work fails the mark stays, and the rows come again.

        period, if given, is a condition on the period, for rows within some days alone.
        """
        fresh = [n for n in self.batches() if n > self.mark(reader)]
        if fresh:
            rows = self._read(fresh)
            work(rows if period is None else rows.where(period))
            files, path = _files(self.spark, self.path)
            files.mkdir(path(f"{self.path}/marks/{reader}/{fresh[-1]:012d}"), None, True)
        return self.mark(reader)
