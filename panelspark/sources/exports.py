"""Tables handed to consumers: purchase scores, drop risk, serving extract, fitted models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import held_names, names_of
from panelspark.operators.business import client_risk, with_risk
from panelspark.session import new_shared_folder
from panelspark.spec import PanelSpec


def export_purchase_scores(portfolio: DataFrame, spec: PanelSpec) -> DataFrame:
    """(entity, prob_buy, took_up, recommended names) from ``score_portfolio``.

    The outcome travels with the scored row, so attaching it costs no join.
    """
    return portfolio.select(
        "entity", "prob_buy", "took_up", names_of(F.col("recommended"), spec.items).alias("recommended")
    )


def export_drop_scores(scored: DataFrame, calibrated: str = "p", raw: str = "p_item") -> DataFrame:
    """(entity, item, prob_drop, prob_drop_raw)."""
    return scored.select(
        "entity", "item", F.col(calibrated).alias("prob_drop"), F.col(raw).alias("prob_drop_raw")
    )


def serving_extract(
    purchase: DataFrame, drops: DataFrame, features: DataFrame, spec: PanelSpec, n: int,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Top n by purchase score, with the riskiest item's risk, holdings, counters and profile columns.

    The top n is taken before the joins: no join can change it, and all then have an
    n-row side.
    """
    top = purchase.orderBy(F.desc("prob_buy"), "entity").limit(n)
    wanted = F.broadcast(top.select("entity"))
    risk = client_risk(drops.join(wanted, "entity", "left_semi"), "prob_drop")
    context = features.join(wanted, "entity", "left_semi").select(
        "entity", "n_prev", "prev_activity", "history",
        held_names(F.col("prev_bits"), spec.items).alias("held"),
    )
    extract = with_risk(top, risk).join(context, "entity", "left")
    if profile is None:
        return extract
    return extract.join(profile.join(wanted, "entity", "left_semi"), "entity", "left")


def write_bucketed(df: DataFrame, name: str, buckets: int = 64, key: str = "entity") -> DataFrame:
    """Write a table in buckets of the key and read it back.

    Consumers that join two such tables of equal bucket count by the key need no exchange.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", new_shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
