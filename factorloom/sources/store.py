"""Daily prices as a table laid out for the panel, with what the planner needs to know.

A store holds the rows of ``exchange`` folders, each divided into buckets by security.
Reading it, a window or aggregate by (exchange, security) finds its rows where they
are, so a panel moves no daily row; a filter by country reads only the folders of its
exchanges, also when the exchanges are known at run time only (dynamic pruning); and the
files are sorted by security and day.

Beside the rows a store has a small table of its series: rows, first and last day of
each (exchange, security) of each load.  Loads add up, so the longest series are known
without reading prices, and whether a series is cut into ranges is decided from this
table when a plan is built.

Buckets are a layout, not a limit on a task: a series that is cut into ranges is
moved by range as in any other frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "exchg"
BUCKET = "isin"
ROWS_PER_BUCKET = 4_000_000


@dataclass(frozen=True)
class DailyStore:
    """A table of prices and the table of its series; ``buckets`` is fixed when it is made."""

    spark: SparkSession
    table: str
    path: str
    day: str = "datadate"

    @classmethod
    def create(cls, prices: DataFrame, table: str, path: str, buckets: int | None = None,
               day: str = "datadate") -> DailyStore:
        """Writes ``prices`` to ``path`` and registers it as ``table``.

        Without ``buckets`` there is one for every ``ROWS_PER_BUCKET`` rows of the first
        load, and at least one for each shuffle partition.
        """
        spark = prices.sparkSession
        store = cls(spark, table, path.rstrip("/"), day)
        if buckets is None:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(parts, -(-prices.count() // ROWS_PER_BUCKET))
        store._write(prices, buckets)
        return store

    @classmethod
    def open(cls, spark: SparkSession, table: str, path: str, day: str = "datadate") -> DailyStore:
        """A store that a session with the same catalog has made."""
        return cls(spark, table, path.rstrip("/"), day)

    def append(self, prices: DataFrame) -> None:
        """Adds a load.  Its series are counted on their own and added to the others."""
        self._write(prices, self.buckets)

    @property
    def buckets(self) -> int:
        found = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
        return int(found["data_type"])

    def prices(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows, strictly between two days."""
        rows = self.spark.table(self.table)
        if start is not None:
            rows = rows.filter(F.col(self.day) > F.lit(start).cast("date"))
        if end is not None:
            rows = rows.filter(F.col(self.day) < F.lit(end).cast("date"))
        return rows

    def series(self) -> DataFrame:
        """``exchg``, ``isin``, ``n_rows``, ``first_day`` and ``last_day`` of every series."""
        loads = self.spark.read.parquet(f"{self.path}/series")
        return loads.groupBy(FOLDER, BUCKET).agg(
            F.sum("n_rows").alias("n_rows"), F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"))

    def _write(self, prices: DataFrame, buckets: int) -> None:
        """Series are counted first: a load that fails half way leaves them counted too high, which
        cuts a series that need not be cut, and never too low."""
        named = prices.filter(F.col(FOLDER).isNotNull() & F.col(BUCKET).isNotNull())
        series = named.groupBy(FOLDER, BUCKET).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(self.day).alias("first_day"),
            F.max(self.day).alias("last_day"))
        series.coalesce(1).write.mode("append").parquet(f"{self.path}/series")
        (named.repartition(buckets, BUCKET).write.mode("append").format("parquet").option("path", f"{self.path}/rows")
         .partitionBy(FOLDER).bucketBy(buckets, BUCKET).sortBy(BUCKET, self.day).saveAsTable(self.table))


def store_exchanges(exchanges: DataFrame, path: str) -> DataFrame:
    """The map of exchanges as a table.  A filter on it can prune a store at run time, which the
    planner does not try for rows that stand in the query."""
    exchanges.write.parquet(path)
    return exchanges.sparkSession.read.parquet(path)
