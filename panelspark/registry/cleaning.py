"""Scans, cleaning and layout (S*, C*, O*, B8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import clean, layout, metrics, split
from panelspark.registry.core import Data, query
from panelspark.session import new_shared_folder
from panelspark.sources import files, panels
from panelspark.sources.panels import MISSING_PRIORITY


def dirty_orders(d: Data):
    """Orders as padded text with markers, unparsable prices and a seniority sentinel."""
    orders = d.table("orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("  "), key.cast("string"), F.lit(" ")).alias("order_id"),
        F.when(F.col("o_orderpriority") == MISSING_PRIORITY, "NA")
        .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  "))).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "  ")
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "))).alias("day"),
        F.when(F.pmod(key, F.lit(50)) == 0, "n/d").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.pmod(key, F.lit(40)) == 0, "-999999")
        .otherwise(F.concat(F.lit(" "), F.pmod(key, F.lit(100)).cast("string"))).alias("seniority"),
    )


def clean_orders(d: Data):
    text = clean.null_markers(clean.trim_all(dirty_orders(d)))
    rows = clean.typed(text, ints=("order_id", "seniority"), doubles=("price",), dates=("day",))
    return clean.sentinel_to_null(rows, "seniority", F.col("seniority") < 0)


def profiled(d: Data):
    """Usable rows with the entity's profile."""
    return d.features.select("entity", "period", "n_prev", "prev_activity", "history").join(
        d.profile, "entity", "left"
    )


@query("s3_read_columns")
def _(d: Data):
    return files.read_panel(d.spark, f"{d.folder}/orders.parquet", ["o_orderkey", "o_custkey"])


@query("s4_read_period", "ab")
def _(d: Data):
    """The panel written by period, and one period read back through its folder."""
    path = new_shared_folder(d.spark, "panel")
    files.write_by_period(d.panel, path)
    return files.read_period(d.spark, path, d.spec.measured)


MEASURED_DATE = {"daily": "2024-01-30", "quarterly": "2001-05-15"}


@query("s4_period_by_date", "ab")
def _(d: Data):
    """The panel written by period; a date says which one is read."""
    path = new_shared_folder(d.spark, "panel")
    files.write_by_period(d.panel, path)
    calendar = panels.period_calendar(d.spark, d.folder, d.spec)
    return files.read_period_on(d.spark, path, calendar, MEASURED_DATE[d.spec.name]).select("entity", "period", "held", "activity")


@query("t1_split_by_date", "ab")
def _(d: Data):
    cutoff = files.period_on(panels.period_calendar(d.spark, d.folder, d.spec), MEASURED_DATE[d.spec.name])
    return split.split_at(d.features, cutoff).select("entity", "period", "part")


CSV_COLUMNS = ("customer", "name", "segment", "balance")


def csv_scan(d: Data):
    """Customers as CSV lines with quoted commas and quotes, one in 41 broken, and what the scan makes of them."""
    key = F.col("c_custkey")
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('"""'))
    whole = F.concat_ws(",", key.cast("string"), quoted, F.col("c_mktsegment"), F.floor(F.col("c_acctbal")).cast("string"))
    short = F.concat_ws(",", key.cast("string"), F.col("c_name"))
    long = F.concat(whole, F.lit(",more,fields"))
    rest = F.pmod(key, F.lit(41))
    lines = d.table("customer").select(F.when(rest == 7, short).when(rest == 9, long).otherwise(whole).alias("value"))
    path = new_shared_folder(d.spark, "csv")
    lines.write.text(path)
    return files.scan_snapshots_csv(d.spark, path, CSV_COLUMNS, header=False)


@query("s1_csv_scan")
def _(d: Data):
    accepted, rejected = csv_scan(d)
    empty = [F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]
    return accepted.withColumn(files.REJECTED, F.lit(None).cast("string")).unionByName(rejected.select(*empty, files.REJECTED))


@query("s9_scan_reconciliation")
def _(d: Data):
    """Lines read, rows written and lines rejected of the scan, the rows counted where they were written."""
    accepted, rejected = csv_scan(d)
    path = new_shared_folder(d.spark, "accepted")
    accepted.write.parquet(path)
    return files.scan_reconciliation(accepted, rejected, files.read_panel(d.spark, path))


@query("o3_enrich_group_mean_salted")
def _(d: Data):
    customer = d.table("customer", "c_custkey", "c_nationkey", "c_acctbal")
    return layout.enrich_group_mean(customer, "c_nationkey", "c_acctbal", strategy="salted")


@query("o1_hot_keys")
def _(d: Data):
    """Event types that fill more than a quarter of an even task out of two, as the sketch finds them."""
    hot = layout.hot_keys(d.table("events", "event_type"), "event_type", 2)
    return hot.select("event_type", (F.col("cuts") > 0).alias("hot"))


@query("s9_row_reconciliation")
def _(d: Data):
    return files.row_reconciliation(d.table("orders"), clean_orders(d))


def price_as_decimal(rows):
    """The price's text with two digits, however the engine prints a double; other text stays."""
    number = F.expr("try_cast(price AS decimal(18,2))").cast("string")
    return rows.withColumn("price", F.coalesce(number, "price"))


@query("c1_trim_all")
def _(d: Data):
    return price_as_decimal(clean.trim_all(dirty_orders(d)))


@query("c2_null_markers")
def _(d: Data):
    return price_as_decimal(clean.null_markers(clean.trim_all(dirty_orders(d))))


@query("c3_typed")
def _(d: Data):
    text = clean.null_markers(clean.trim_all(dirty_orders(d)))
    return clean.typed(text, ints=("order_id", "seniority"), doubles=("price",), dates=("day",))


@query("c4_sentinel_to_null")
def _(d: Data):
    return clean_orders(d)


@query("c5_null_audit")
def _(d: Data):
    return clean.null_audit(clean_orders(d), ["priority", "day", "price", "seniority"])


@query("c6_item_columns")
def _(d: Data):
    """Columns found by a pattern with the rows that fill them, and whether a wrong count is an error."""
    rows = d.table("lineitem")
    found = clean.item_columns(rows, r"l_\w+key", 3)
    try:
        clean.item_columns(rows, r"l_\w+key", 24)
        guarded = False
    except ValueError:
        guarded = True
    filled = rows.agg(*[F.count(c).alias(c) for c in found])
    return filled.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in found])),
    ).withColumn("guarded", F.lit(guarded))


@query("c7_flag_missing", "b")
def _(d: Data):
    return clean.flag_missing(profiled(d), ["income", "prev_activity"]).select(
        "entity", "period", "income", "income_missing", "prev_activity", "prev_activity_missing"
    )


@query("c8_fold_rare", "b")
def _(d: Data):
    rows = profiled(d)
    train = rows.filter(F.col("period") < d.spec.decision)
    return clean.fold_rare(rows, "province", 10, learn_from=train).select("entity", "period", "province")


@query("c9_median_fill", "b")
def _(d: Data):
    """Null incomes take the exact discrete median of the known ones."""
    known = d.profile.filter(F.col("income").isNotNull()).withColumn("zero", F.lit(0))
    cut = metrics.exact_cuts(metrics.cumulative_histogram(known, "income", "zero"), [500])
    median = cut.select(F.lit(1).alias("one"), F.col("cut_500.score").alias("median"))
    return (
        d.profile.withColumn("one", F.lit(1)).join(F.broadcast(median), "one")
        .select("entity", F.coalesce("income", "median").alias("income"))
    )


@query("c14_standardize", "b")
def _(d: Data):
    rows = profiled(d)
    columns = ["income", "n_prev", "prev_activity", "history"]
    train = rows.filter(F.col("period") < d.spec.decision)
    served = rows.filter(F.col("period") >= d.spec.decision)
    return clean.standardize(train, served, columns).select(
        "entity", "period",
        *[F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(f"{c}_micro") for c in columns],
    )


@query("b8_missing_by", "b")
def _(d: Data):
    return clean.missing_by(d.profile, "income", "province")


@query("o1_skew_report", "ab")
def _(d: Data):
    return layout.skew_report(d.panel, "period")


@query("o2_rows_by_period", "ab")
def _(d: Data):
    return layout.rows_by_period(d.panel)


@query("o3_enrich_group_mean")
def _(d: Data):
    customer = d.table("customer", "c_custkey", "c_nationkey", "c_acctbal")
    return layout.enrich_group_mean(customer, "c_nationkey", "c_acctbal")


@query("o3_enrich_group_mean_merge")
def _(d: Data):
    customer = d.table("customer", "c_custkey", "c_nationkey", "c_acctbal")
    return layout.enrich_group_mean(customer, "c_nationkey", "c_acctbal", strategy="merge")


@query("o4_group_profile", "b")
def _(d: Data):
    return layout.group_profile(d.profile, "region", "income")
