"""Skew handling, sinks, the date cut-off and the scan that keeps what it rejects."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark.operators import layout, split
from panelspark.sources import exports, files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def fixed_parts(spark):
    """Sixteen even tasks, without the run-time merging and splitting of partitions."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield 16
    for n, v in before.items():
        spark.conf.set(n, v)


def test_one_key_of_a_third_spreads_over_tasks(spark, fixed_parts):
    rows = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 5000)
    df = spark.range(rows).select(key.alias("k"), F.col("id").alias("v"))
    small = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = layout.salted_join(df, small, "k")
    sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 16 and sum(sizes) == rows
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = sorted(r["count"] for r in df.join(small.hint("merge"), "k").groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert plain[-1] > 4 * plain[len(plain) // 2]
    assert "SortMergeJoin" in plan_of(joined)
    wrong = joined.join(small.withColumnRenamed("n", "m"), "k").filter("n != m")
    assert wrong.isEmpty() and joined.select("v").distinct().count() == rows


def test_hot_keys_misses_none(spark, monkeypatch):
    monkeypatch.setattr(layout, "TRACKED", 20)
    df = spark.range(30_000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, F.concat(F.lit("warm"), F.col("id") % 3)).otherwise(F.col("id").cast("string")).alias("k"))
    found = {r.k: r.cuts for r in layout.hot_keys(df.repartition(7), "k", 1).collect()}
    assert {"hot"} <= set(found) <= {"hot", "warm0", "warm1", "warm2"}
    assert found["hot"] >= 2
    assert layout.hot_keys(df.limit(0), "k", 4).collect() == []


def test_salted_join_keeps_null_keys_and_strategies_agree(spark):
    df = spark.createDataFrame([(i % 3 or None, float(i)) for i in range(50)] + [(5, None)], "k long, v double")
    plain, salted = (sorted(map(str, layout.enrich_group_mean(df, "k", "v", s).collect())) for s in ("auto", "salted"))
    assert plain == salted
    with pytest.raises(ValueError):
        layout.enrich_group_mean(df, "k", "v", "other")


def test_bucketed_sinks_join_without_exchange(spark, fixed_parts):
    left = exports.write_bucketed(spark.range(500).select(F.col("id").alias("entity"), F.rand(1).alias("prob_buy")), "buy", 4)
    right = exports.write_bucketed(spark.range(300).select(F.col("id").alias("entity"), F.rand(2).alias("prob_drop")), "drop", 4)
    joined = left.join(right.hint("merge"), "entity")
    assert joined.count() == 300
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)


def test_a_date_prunes_the_other_periods(spark, tmp_path):
    path = str(tmp_path / "panel")
    files.write_by_period(spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("period")), path)
    days = [(p, f"2020-0{p + 1}-01", f"2020-0{p + 1}-28") for p in range(5)]
    calendar = spark.createDataFrame(days, "period int, first string, last string").selectExpr("period", "date(first) first", "date(last) last")
    read = files.read_period_on(spark, path, calendar, "2020-03-17")
    assert "dynamicpruning" in plan_of(read).lower()
    assert {r.period for r in read.collect()} == {2} and read.count() == 20
    assert files.read_period_on(spark, path, calendar, "2020-03-30").count() == 0  # between two periods
    rows = split.split_at(spark.read.parquet(path), files.period_on(calendar, "2020-03-01"))
    assert {(r.period, r.part) for r in rows.collect()} == {(0, "train"), (1, "train"), (2, "measured")}


def test_scan_keeps_what_it_rejects(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('id,name,city\n1,"a ""b"", c",x\n2,short\n3,y,z,more\n4,,\n')
    accepted, rejected = files.scan_snapshots_csv(spark, str(path), ["id", "name", "city"])
    assert sorted(map(tuple, accepted.collect()), key=str) == [("1", 'a "b", c', "x"), ("4", None, None)]
    assert sorted(r[0] for r in rejected.collect()) == ["2,short", "3,y,z,more"]
    assert files.scan_reconciliation(accepted, rejected, accepted).first() == (4, 2, 2, True)
    assert files.scan_reconciliation(accepted, rejected, accepted.limit(1)).first().equal is False
    assert accepted.select("name").count() == 2  # a pruned read sees the same lines as broken


def test_serving_extract_with_profile(spark, small, make_panel):
    purchase = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 0), (3, 0.7, 0)], "entity long, prob_buy double, took_up int")
    drops = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4), (9, "a", 0.9)], "entity long, item string, prob_drop double")
    features = spark.createDataFrame([(i, 1, 2, 3, 5) for i in (1, 2, 3)], "entity long, n_prev int, prev_activity long, history long, prev_bits long")
    profile = spark.createDataFrame([(1, "gold"), (2, "tin")], "entity long, segment string")
    rows = {r.entity: r for r in exports.serving_extract(purchase, drops, features, small, 2, profile).collect()}
    assert set(rows) == {1, 3} and rows[1].segment == "gold" and rows[3].segment is None
    assert rows[1].prob_drop == 0.4 and rows[3].prob_drop == 0.0 and rows[1].held == ["a", "c"]


def test_fits_scan_even_parts_for_every_core(spark, monkeypatch):
    from panelspark import session

    rows = spark.range(4000).select(F.col("id").alias("entity"), (F.col("id") % 7).cast("int").alias("period"))
    table = session.materialize(rows.coalesce(1))
    assert session.dealt(table, "entity", "period").inputFiles() == table.inputFiles()
    monkeypatch.setattr(session, "SMALL", 1000)
    made = session.dealt(table, "entity", "period")
    sizes = [r["count"] for r in made.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.5 * 4000 / len(sizes)
    assert sorted(made.collect()) == sorted(table.collect())


def test_files_of_a_dealt_table_are_not_put_together_again(spark, monkeypatch):
    """Two small files a core were read by one task, so a task's rows grew with the table."""
    from panelspark import session

    name, cores = "spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SMALL", 1000)
    monkeypatch.setattr(session, "MOST", 250)
    try:
        rows = spark.range(4000).select(F.col("id").alias("entity"), (F.col("id") % 7).cast("int").alias("period"))
        made = session.dealt(rows, "entity", "period")
        assert made.rdd.getNumPartitions() == cores * -(-4000 // (250 * cores)) > cores
        read = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert max(read) < 2 * 250
    finally:
        spark.conf.unset(name)
