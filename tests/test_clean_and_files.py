from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark import session
from panelspark.operators import clean, features as feat, layout
from panelspark.sources import files, panels
from panelspark.spec import DAILY

CSV = """id,day,age,seniority,income,province,item_a_x,item_b_x
1,2015-01-28,  35 ,     6,87218.10,"CORUNA, A",0,1
2,2015-01-28, 23,-999999,NA,MADRID, ,1
3,,xx, 12,1e3,NA,1,
"""


def test_csv_to_typed_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV)
    columns = ["id", "day", "age", "seniority", "income", "province", "item_a_x", "item_b_x"]
    raw = files.read_snapshots_csv(spark, str(path), columns)
    assert set(dict(raw.dtypes).values()) == {"string"}
    items = clean.item_columns(raw, r"item_\w_x", 2)
    rows = clean.typed(
        clean.null_markers(clean.trim_all(raw)), ints=("id", "age", "seniority", *items),
        doubles=("income",), dates=("day",),
    )
    rows = clean.sentinel_to_null(rows, "seniority", F.col("seniority") < 0)
    one, two, three = rows.orderBy("id").collect()
    assert (one.province, one.age, one.income, one.seniority) == ("CORUNA, A", 35, 87218.1, 6)
    assert (two.seniority, two.income, two.item_a_x, two.item_b_x) == (None, None, None, 1)
    assert (three.day, three.age, three.province, three.income) == (None, None, None, 1000.0)
    audit = {r.column: r.nulls for r in clean.null_audit(rows, ["age", "income", "province"]).collect()}
    assert audit == {"age": 1, "income": 1, "province": 1}
    files.assert_same_rows(raw, rows)
    with pytest.raises(ValueError):
        files.assert_same_rows(raw, rows.limit(2))
    with pytest.raises(ValueError):
        clean.item_columns(raw, r"item_\w_x", 24)


def test_fold_rare_learns_on_train_and_breaks_ties_by_value(spark):
    values = ["b", "a", "a", "b", "c", None, None, None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    folded = sorted(r.x for r in clean.fold_rare(df, "x", 1).collect())
    assert folded == ["OTROS"] * 6 + ["a", "a"]
    served = spark.createDataFrame([("c",), ("a",)], "x string")
    assert sorted(r.x for r in clean.fold_rare(served, "x", 2, learn_from=df).collect()) == ["OTROS", "a"]


def test_standardize_uses_train_statistics(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    other = spark.createDataFrame([(4.0, 6.0), (None, 5.0)], "x double, flat double")
    rows = clean.standardize(train, other, ["x", "flat"]).collect()
    assert [(r.x, r.flat) for r in rows] == [(2.0, 1.0), (-2.0, 0.0)]


def test_median_fill(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "x double")
    other = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert sorted(r.x for r in clean.fill_median(train, other, ["x"], 0.0).collect()) == [2.0, 5.0]


def test_period_folders_and_pruning(spark, make_panel, small, tmp_path):
    panel = make_panel({(e, p): "ab" for e in range(20) for p in range(3)})
    path = str(tmp_path / "panel")
    files.write_by_period(panel, path)
    folders = sorted(tmp_path.glob("panel/period=*"))
    assert [f.name for f in folders] == ["period=0", "period=1", "period=2"]
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    one = files.read_period(spark, path, 1).select("entity", "held")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    schema = plan[plan.index("ReadSchema"):].splitlines()[0]
    assert "held" in schema and "activity" not in schema
    assert one.count() == 20
    files.assert_same_rows(panel, files.read_panel(spark, path))


def test_a_period_can_spread_over_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 64).select(F.col("id").alias("entity"), F.lit(0).alias("period"))
    panel = rows.withColumn("held", F.lit(1).cast("long"))
    path = str(tmp_path / "spread")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200b")  # as if each piece were large
    try:
        files.write_by_period(panel, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("spread/period=0/*.parquet"))) > 32
    assert spark.read.parquet(path).count() == 4000


def test_join_strategies_agree(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None)], "k string, v double")
    auto = layout.enrich_group_mean(df, "k", "v")
    merge = layout.enrich_group_mean(df, "k", "v", "merge")
    assert "SortMergeJoin" in merge._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, auto.collect())) == sorted(map(str, merge.collect()))
    assert {(r.k, r.mean_v) for r in auto.collect()} == {("x", 2.0), ("y", None)}


def test_skew_report(spark):
    df = spark.createDataFrame([(1,)] * 6 + [(2,)] * 2, "k int")
    row = layout.skew_report(df, "k").first()
    assert (row.groups, row.rows_max, row.rows_min, row.max_over_mean) == (2, 6, 2, 1.5)
    assert layout.skew_report(df.repartition(3)).first().groups <= 3


def test_hot_entity_collapses_before_the_window(spark, tmp_path):
    """One user with most raw rows reaches the windows with one row per day."""
    hot = spark.range(3000).select(
        F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % 10).cast("int"))).alias("ts"),
        F.lit("click").alias("event_type"),
    )
    cold = spark.range(100).select(
        (F.col("id") + 2).alias("user_id"), F.col("id").alias("event_id"),
        F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"),
    )
    hot.unionByName(cold).write.parquet(str(tmp_path / "events.parquet"))
    panel = panels.daily_panel(spark, str(tmp_path))
    assert panel.filter("entity = 1").count() == 10
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan
    assert feat.build_features(panel, DAILY).filter("entity = 1").count() == 9


def test_checkpoint_folder_comes_from_the_session(monkeypatch):
    class Context:
        master, chosen = "spark://cluster:7077", None

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.chosen = path

    class Session:
        def __init__(self, shared):
            self.sparkContext, self.shared = Context(), shared
            self.conf = self

        def get(self, key, default=None):
            return self.shared or default

    shared = Session("s3://shared/checkpoints")
    session.ensure_checkpoint_dir(shared)
    assert shared.sparkContext.chosen == "s3://shared/checkpoints"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session(None))
