"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.schema import conform
from factorloom.session import materialize

ROWS_PER_FILE = 2_000_000


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if schema is None else conform(df, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header row; columns are matched by name, NaN becomes NULL.

    A field that is not of the stated type is NULL, as a missing one;
    ``failed_casts`` counts these.
    """
    text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    absent = [f.name for f in schema.fields if f.name not in text.columns]
    if absent:
        raise ValueError(f"columns missing from {path}: {absent}")
    return conform(text.select([F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
                                .alias(f.name) for f in schema.fields]), schema)


def read_export(spark: SparkSession, path: str, columns, schema: T.StructType,
                is_data) -> DataFrame:
    """A spreadsheet exported as CSV, with title, section and footer lines.

    ``columns`` names the file's columns by position.  Lines are kept by the
    predicate ``is_data`` rather than by their number, so that the file can be
    split among tasks and its sections may move.
    """
    text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return data_rows(text.option("mode", "PERMISSIVE").csv(path), schema, is_data)


def data_rows(text: DataFrame, schema: T.StructType, is_data) -> DataFrame:
    """Rows of an all-string export that satisfy ``is_data``, cast to ``schema``."""
    return text.filter(is_data).select([
        F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").alias(f.name)
        for f in schema.fields])


def failed_casts(text: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: for each column how many fields hold text that is not of its type."""
    return text.agg(*[F.count(F.when(
        F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").isNull()
        & (F.trim(F.col(f"`{f.name}`")) != ""), 1)).alias(f.name) for f in schema.fields])


def is_number(name: str):
    """Predicate: the column holds a whole number (a rank, a key)."""
    return F.expr(f"try_cast(trim(`{name}`) AS bigint)").isNotNull()


def matches(name: str, pattern: str):
    """Predicate: the column holds a code of the given form."""
    return F.coalesce(F.col(name).rlike(pattern), F.lit(False))


def checked_rows(text: DataFrame, schema: T.StructType, is_data=None, required=()) -> DataFrame:
    """All rows of an all-string frame, cast to ``schema``, with why a row is rejected.

    ``reason`` is NULL for a good row, else the first of: the line is broken (``_broken``,
    where the reader gives it), it is no data row (``is_data``), a required field is
    missing, a field is not of its type.  ``fields`` are the row's texts as read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    typed = {name: F.expr(f"try_cast(trim(`{name}`) AS {kind})") for name, kind in kinds.items()}
    held = {name: F.coalesce(F.trim(F.col(f"`{name}`")) != "", F.lit(False)) for name in kinds}
    reason = F.lit(None).cast("string")
    for name in reversed(list(kinds)):
        reason = F.when(held[name] & typed[name].isNull(), F.lit(f"{name} is no {kinds[name]}")).otherwise(reason)
    for name in reversed(list(required)):
        reason = F.when(~held[name], F.lit(f"{name} is missing")).otherwise(reason)
    if is_data is not None:
        reason = F.when(~F.coalesce(is_data, F.lit(False)), F.lit("no data row")).otherwise(reason)
    if "_broken" in text.columns:
        reason = F.when(F.col("_broken").isNotNull(), F.lit("broken line")).otherwise(reason)
    fields = F.array(*[F.col(f"`{c}`") for c in text.columns])
    return text.select(*[typed[name].alias(name) for name in kinds], fields.alias("fields"), reason.alias("reason"))


def quarantined(text: DataFrame, schema: T.StructType, is_data=None, required=()) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected ones (``fields``, ``reason``), of one read of the source."""
    rows = materialize(checked_rows(text, schema, is_data, required), "checked")
    good = rows.filter("reason IS NULL").select(*[f.name for f in schema.fields])
    return good, rows.filter("reason IS NOT NULL").select("fields", "reason")


def read_export_lines(spark: SparkSession, path: str, columns) -> DataFrame:
    """A spreadsheet exported as CSV as text columns, with ``_broken`` for lines of another number of fields."""
    layout = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_broken"]])
    return (spark.read.schema(layout).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").csv(path))


def _spread(df: DataFrame, by: list[str], rows_per_file: int):
    """A writer with one shuffle by partition, whose large partitions adaptive execution divides by
    size, equal rows too, and whose small ones it puts together."""
    return (df.hint("rebalance", *[F.col(c) for c in by]).write
            .option("maxRecordsPerFile", rows_per_file).partitionBy(*by))


def write_panel(df: DataFrame, path: str, by=("year",), mode: str = "errorifexists",
                rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write an annual panel partitioned for pruned reads, one shuffle, few files.

    An existing table is not replaced unless ``mode`` says so.
    """
    _spread(df, list(by), rows_per_file).mode(mode).parquet(path)


def replace_partitions(df: DataFrame, path: str, by=("year",), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the partitions that ``df`` has rows of, in place of those of the table.

    The rows are staged beside the table and put in place when all tasks are done, so a
    load may be repeated, or fail and be repeated, and other partitions are not touched.
    A partition of which ``df`` has no row stays as it is.
    """
    (_spread(df, list(by), rows_per_file).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def first_rows(df: DataFrame, order, n: int = 5) -> DataFrame:
    """Preview: the first ``n`` rows in a stated order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Preview: ``n`` random rows (a distributed top-n on a hash of seed and ``key``).

    The hash is MD5 of the seed, a bar and the key as text, so other engines
    and later runs pick the same rows; rows of equal keys follow in no stated order.
    """
    random = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", random).orderBy("_r").limit(n).drop("_r")
