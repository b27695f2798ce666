"""How rows are spread, and joins and aggregates whose layout matters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize


def skew_report(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows per key (or per partition): groups, largest, smallest, mean, largest over mean."""
    group = F.spark_partition_id() if key is None else F.col(key)
    sizes = df.groupBy(group.alias("group")).agg(F.count("*").alias("rows"))
    totals = sizes.agg(
        F.count("*").alias("groups"), F.max("rows").alias("rows_max"),
        F.min("rows").alias("rows_min"), F.sum("rows").alias("rows_all"),
    )
    mean = F.col("rows_all") / F.col("groups")
    return totals.select(
        "groups", "rows_max", "rows_min", mean.alias("rows_mean"),
        (F.col("rows_max") * F.col("groups") / F.col("rows_all")).alias("max_over_mean"),
    )


def rows_by_period(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(F.count("*").alias("rows")).orderBy("period")


def group_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean in hundredths-exact sums, and count, over rows where the value is known."""
    cents = F.sum(F.floor(F.col(value) * 100 + 0.5).cast("decimal(38,0)")).cast("double")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(key)
        .agg((cents / (F.count("*") * 100)).alias("mean"), F.count("*").alias("rows"))
    )


TRACKED = 1_000  # counters of the heavy-hitter sketch: every key above a thousandth of the rows is found
PART_SHARE = 8  # a hot key's part is an eighth of an even task


def hot_keys(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, cuts) of the keys with more rows than an even task's PART_SHARE-th part, and their number of parts.

    Each task keeps at most TRACKED counters (Misra and Gries): when they are full, all fall by one.
    The tasks' counters are added, and a key's sum is below its rows by at most a
    TRACKED-th of all, which is added back; so no key above that share is missed, and the result
    has at most TRACKED * PART_SHARE rows whatever the number of keys.
    """
    kind = df.schema[key].dataType.simpleString()

    def track(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict = {}
        rows = 0
        for frame in frames:
            rows += len(frame)
            for value, n in frame[key].value_counts().items():  # nulls join with nothing
                counters[value] = counters.get(value, 0) + n
            if len(counters) > TRACKED:  # the same as one fall for each row beyond the room
                fall = sorted(counters.values())[-TRACKED - 1]
                counters = {v: n - fall for v, n in counters.items() if n > fall}
        values = pd.Series([None, *counters], dtype=object)
        yield pd.DataFrame({key: values, "n": [rows, *counters.values()], "total": [True] + [False] * len(counters)})

    sketch = df.select(key).mapInPandas(track, f"`{key}` {kind}, n long, total boolean")
    counted = sketch.groupBy(key, "total").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "heavy-hitters")
    rows = counted.filter("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    even = F.greatest(F.ceil(F.col("rows") / (parts * PART_SHARE)), F.lit(1))
    most = F.col("n") + F.ceil(F.col("rows") / TRACKED)
    found = counted.filter("not total").join(F.broadcast(rows))
    return found.filter(F.col("n") > even).select(key, F.ceil(most / even).cast("int").alias("cuts"))


def salted_join(df: DataFrame, small: DataFrame, key: str, parts: int | None = None, how: str = "left") -> DataFrame:
    """A sort-merge join that deals the rows of hot keys over several tasks, and only theirs.

    The other side's row of a hot key is repeated once per part.  Rows are dealt by a hash of
    their columns, so a re-run task deals them alike.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(materialize(hot_keys(df, key, parts), "hot-keys"))  # bounded, see hot_keys
    cuts = F.coalesce("cuts", F.lit(1))
    dealt = df.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*df.columns), cuts).cast("int")).drop("cuts")
    spread = small.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
    joined = dealt.join(spread.hint("merge"), [key, "__part"], how)
    return joined.drop("__part")


def enrich_group_mean(df: DataFrame, key: str, value: str, strategy: str = "auto") -> DataFrame:
    """Each row with the mean of its group.

    ``auto`` leaves the join to the measured size of the group table, ``merge`` forces the
    sort-merge plan, ``salted`` also deals the rows of hot groups over tasks.  A window
    would put a whole group into one task.
    """
    means = group_profile(df, key, value).select(key, F.col("mean").alias(f"mean_{value}"))
    if strategy == "salted":
        return salted_join(df, means, key)
    if strategy == "merge":
        means = means.hint("merge")
    elif strategy != "auto":
        raise ValueError(f"unknown join strategy: {strategy}")
    return df.join(means, key, "left")
