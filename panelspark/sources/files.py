"""Reading and writing panels as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import materialize


def read_snapshots_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Raw snapshots, every column as text by an explicit schema.

    No inference pass over the file, and quoted commas stay inside their field.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


REJECTED = "rejected_line"


def scan_snapshots_csv(
    spark: SparkSession, path: str, columns: Sequence[str], header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected lines): a line with too few or too many fields is kept as text.

    The scan is written once with all columns, because a scan of some columns would not
    see that a line is broken.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, REJECTED)])
    read = (
        spark.read.schema(schema)
        .option("header", header).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)
        .csv(path)
    )
    stored = materialize(read, "scan")
    accepted = stored.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    return accepted, stored.filter(F.col(REJECTED).isNotNull()).select(REJECTED)


def scan_reconciliation(accepted: DataFrame, rejected: DataFrame, written: DataFrame) -> DataFrame:
    """Lines read, rows written, lines rejected, and whether they add up, as one row."""
    sides = [(accepted, "accepted"), (rejected, "rejected"), (written, "written")]
    counts = None
    for df, name in sides:
        one = df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
        counts = one if counts is None else counts.join(F.broadcast(one), "one")
    return counts.select(
        (F.col("accepted") + F.col("rejected")).alias("read"), "written", "rejected",
        (F.col("accepted") == F.col("written")).alias("equal"),
    )


def write_by_period(
    df: DataFrame, path: str, column: str = "period"
) -> None:
    """One folder per period; adaptive execution splits a large period over as many tasks as
    its size asks for, and merges small ones down to one file."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_period(spark: SparkSession, path: str, period, column: str = "period") -> DataFrame:
    """One period; on a period-partitioned table only its folder is listed and read."""
    return spark.read.parquet(path).filter(F.col(column) == period)


def read_period_on(spark: SparkSession, path: str, calendar: DataFrame, date: str, column: str = "period") -> DataFrame:
    """The period that ``calendar`` (period, first, last) has for a date.

    The period becomes known when the query runs; only its folder is read then (dynamic
    partition pruning).
    """
    return spark.read.parquet(path).join(F.broadcast(period_on(calendar, date, column)), column)


def period_on(calendar: DataFrame, date: str, column: str = "period") -> DataFrame:
    """One row: the newest period that starts on or before a date and has not ended before it; none if there is no such."""
    day = F.lit(date).cast("date")
    inside = calendar.filter((F.col("first") <= day) & (F.col("last") >= day))
    return inside.groupBy().agg(F.max(column).alias(column)).filter(F.col(column).isNotNull())


def row_reconciliation(source: DataFrame, written: DataFrame) -> DataFrame:
    """Both row counts and whether they agree, as one row."""
    def sized(df, name):
        return df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))

    both = sized(source, "source_rows").join(F.broadcast(sized(written, "written_rows")), "one")
    return both.select(
        "source_rows", "written_rows", (F.col("source_rows") == F.col("written_rows")).alias("equal")
    )


def assert_same_rows(source: DataFrame, written: DataFrame) -> None:
    counts = row_reconciliation(source, written).first()
    if not counts.equal:
        raise ValueError(f"{counts.source_rows} rows read but {counts.written_rows} written")
