"""Raw text to typed columns, sentinels and markers to null, rare categories folded."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARKERS = ("", "NA")  # fixed values: texts that mean "unknown"
OTHER = "OTROS"  # fixed value: label of folded categories


def _text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def trim_all(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in _text_columns(df)})


def null_markers(df: DataFrame, markers: Iterable[str] = NULL_MARKERS) -> DataFrame:
    markers = list(markers)
    return df.withColumns(
        {c: F.when(~F.col(c).isin(markers), F.col(c)) for c in _text_columns(df)}
    )


def typed(
    df: DataFrame,
    ints: Sequence[str] = (),
    doubles: Sequence[str] = (),
    dates: Sequence[str] = (),
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Cast by column group; text that does not parse becomes null, not an error."""
    return df.withColumns(
        {
            **{c: F.col(c).try_cast("int") for c in ints},
            **{c: F.col(c).try_cast("double") for c in doubles},
            **{c: F.try_to_date(F.col(c), date_format) for c in dates},
        }
    )


def sentinel_to_null(df: DataFrame, column: str, is_sentinel: Column) -> DataFrame:
    return df.withColumn(column, F.when(is_sentinel, None).otherwise(F.col(column)))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and their share per watched column, in one pass."""
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"nulls_{i}").alias("nulls")) for i, c in enumerate(columns)]
    )
    return totals.select("rows", F.inline(entries)).select(
        "column", "nulls", (100 * F.col("nulls") / F.greatest("rows", F.lit(1))).alias("pct")
    )


def item_columns(df: DataFrame, pattern: str, expected: int) -> list[str]:
    """Item columns by name pattern; a count that differs from the catalogue is an error."""
    found = [c for c in df.columns if re.fullmatch(pattern, c)]
    if len(found) != expected:
        raise ValueError(f"expected {expected} item columns, found {len(found)}: {found}")
    return found


def flag_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as double, each with a 0/1 ``<name>_missing`` companion."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    return df.withColumns({**flags, **{c: F.col(c).cast("double") for c in columns}})


def frequent_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent non-null values; equal counts go to the smaller value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), column)
        .limit(n)
        .select(column)
    )


def fold_rare(
    df: DataFrame, column: str, n: int = 30, label: str = OTHER, learn_from: DataFrame | None = None
) -> DataFrame:
    """Keep the n most frequent categories, fold the rest and null into one label.

    ``learn_from`` takes the train rows, so that later periods do not decide what is rare.
    The kept list has n rows.
    """
    kept = frequent_values(df if learn_from is None else learn_from, column, n).withColumn(
        "is_kept", F.lit(True)
    )
    return (
        df.join(F.broadcast(kept), column, "left")
        .withColumn(column, F.when(F.col("is_kept"), F.col(column)).otherwise(F.lit(label)))
        .drop("is_kept")
        .select(*df.columns)
    )


def median_of(df: DataFrame, columns: Sequence[str], error: float = 0.001) -> dict[str, float | None]:
    """Medians over rows where the value is known; null where none is."""
    found = df.approxQuantile(list(columns), [0.5], error)
    return {c: (values[0] if values else None) for c, values in zip(columns, found)}


def fill_median(train: DataFrame, other: DataFrame, columns: Sequence[str], error: float = 0.001) -> DataFrame:
    """Fill the other table's nulls with the train medians."""
    medians = median_of(train, columns, error)
    return other.fillna({c: m for c, m in medians.items() if m is not None})


def standardize(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale with train statistics; null becomes 0 first, a flat column keeps scale 1."""

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    stats = train.agg(
        F.lit(1).alias("one"),
        *[F.avg(filled(c)).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(filled(c)).alias(f"std_{c}") for c in columns],
    )

    def scale(c: str) -> Column:
        return F.when(F.col(f"std_{c}") < 1e-6, F.lit(1.0)).otherwise(F.col(f"std_{c}"))

    return (
        other.withColumn("one", F.lit(1))
        .join(F.broadcast(stats), "one")
        .withColumns({c: (filled(c) - F.col(f"mean_{c}")) / scale(c) for c in columns})
        .select(*other.columns)
    )


def missing_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """Share of missing values per group."""
    return df.groupBy(by).agg(
        F.count("*").alias("rows"),
        (F.count_if(F.col(column).isNull()) / F.count("*")).alias("missing_rate"),
    )
