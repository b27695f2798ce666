"""Recommendation lists from popularity, conditional rates and given score arrays.

Scores travel as one array per entity in catalogue order; masking, ordering and the
top K are expressions inside the row.  Lists are arrays of catalogue positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import ap_at_k_bits, best_open, full_order, has_item, micro, top_k
from panelspark.operators.features import item_counts
from panelspark.operators.reshape import explode_held
from panelspark.operators.split import mean_ap
from panelspark.spec import PanelSpec

BAND_CAP = 8  # holdings of 8 and more share one rate


def popularity(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """Items by adds in the train rows; equal counts keep catalogue order."""
    counts = item_counts(train, {"adds": "add_bits"}, spec)
    order = Window.orderBy(F.desc("adds"), "idx")  # catalogue-sized
    return counts.withColumn("rank", F.row_number().over(order))


def popularity_scores(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """Adds per item as one row with a score array."""
    return train.agg(_adds_as_scores(spec).alias("scores"))


def _adds_as_scores(spec: PanelSpec, condition: Column | None = None) -> Column:
    def counted(i: int) -> Column:
        flag = has_item(F.col("add_bits"), i)
        return F.coalesce(F.sum(flag if condition is None else F.when(condition, flag)), F.lit(0).cast("long"))

    return F.array(*[counted(i).cast("double") for i in range(spec.n)])


def popularity_by_window(train: DataFrame, spec: PanelSpec, windows: dict[str, Column]) -> DataFrame:
    """One row with a score array per named condition, all from one pass over the train rows."""
    return train.agg(*[_adds_as_scores(spec, c).alias(f"scores_{name}") for name, c in windows.items()])


def band(n_prev: Column) -> Column:
    return F.least(n_prev, F.lit(BAND_CAP))


def band_counts(train: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Per holdings band (and further keys): for each item, adds and rows without the item."""
    totals = train.withColumn("band", band(F.col("n_prev"))).groupBy(*keys, "band").agg(
        *[F.sum(has_item(F.col("add_bits"), i)).alias(f"a{i}") for i in range(spec.n)],
        *[F.sum(1 - has_item(F.col("prev_bits"), i)).alias(f"o{i}") for i in range(spec.n)],
    )
    return totals.select(
        *keys, "band",
        F.array(*[F.col(f"a{i}") for i in range(spec.n)]).alias("adds"),
        F.array(*[F.col(f"o{i}") for i in range(spec.n)]).alias("opens"),
    )


def _rate_array() -> Column:
    return F.zip_with("adds", "opens", lambda a, o: F.when(o > 0, a / o).otherwise(F.lit(0.0)))


def add_rates(train: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Per band: adds over rows where the item was not held, as a score array."""
    return band_counts(train, spec, keys).select(*keys, "band", _rate_array().alias("scores"))


def score_table(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per band with the scores of three models, from a single pass over the train rows.

    Popularity is the sum over the bands, popularity by band and conditional rates are the
    band's own; a band unseen in train keeps popularity and has zeros for the others.
    """
    bands = train.sparkSession.range(BAND_CAP + 1).select(F.col("id").cast("int").alias("band"))
    zeros = F.array(*[F.lit(0).cast("long")] * spec.n)
    counts = bands.join(band_counts(train, spec), "band", "left").withColumns(
        {"adds": F.coalesce("adds", zeros), "opens": F.coalesce("opens", zeros)}
    )
    everything = Window.partitionBy()  # BAND_CAP + 1 rows
    popularity = F.array(*[F.sum(F.get("adds", i)).over(everything).cast("double") for i in range(spec.n)])
    return counts.select(
        "band", popularity.alias("scores_popularity"),
        F.col("adds").cast("array<double>").alias("scores_popularity_by_band"),
        _rate_array().alias("scores_conditional_rate"),
    )


SCORE_TABLE_MODELS = ("popularity", "popularity_by_band", "conditional_rate")


def with_model_scores(rows: DataFrame, train: DataFrame, spec: PanelSpec) -> DataFrame:
    """The three score arrays next to each row, by one join against BAND_CAP + 1 rows."""
    return (
        rows.withColumn("band", band(F.col("n_prev")))
        .join(F.broadcast(score_table(train, spec)), "band")
        .drop("band")
    )


def no_scores(spec: PanelSpec) -> Column:
    return F.array(*[F.lit(0.0)] * spec.n)


def score_by_band(rows: DataFrame, rates: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach the band's score array; the rate table has at most BAND_CAP + 1 rows."""
    return (
        rows.withColumn("band", band(F.col("n_prev")))
        .join(F.broadcast(rates), "band", "left")
        .withColumn("scores", F.coalesce("scores", no_scores(spec)))
        .drop("band")
    )


def score_by_popularity(rows: DataFrame, train: DataFrame, spec: PanelSpec) -> DataFrame:
    """Same scores for everyone, as a one-row broadcast."""
    ranking = popularity_scores(train, spec).withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(ranking), "one").drop("one")


def with_recommendation(scored: DataFrame, spec: PanelSpec, k: int | None = None) -> DataFrame:
    """Top K items not held, by score."""
    return scored.withColumn(
        "recommended", top_k(F.col("scores"), F.col("prev_bits"), k or spec.k)
    )


def recommend_popular(rows: DataFrame, train: DataFrame, spec: PanelSpec, k: int | None = None) -> DataFrame:
    return with_recommendation(score_by_popularity(rows, train, spec), spec, k)


def client_propensity(scored: DataFrame) -> DataFrame:
    """The score of the best item the entity does not hold; 0 if it holds everything."""
    best = best_open(F.col("scores"), F.col("prev_bits"))
    return scored.withColumn("prob_buy", F.coalesce(best, F.lit(0.0)))


def masked_renormalise(scored: DataFrame) -> DataFrame:
    """Held items to zero, the rest scaled to sum 1 (all zero when nothing is left)."""
    masked = F.transform(
        F.col("scores"),
        lambda s, i: F.when(has_item(F.col("prev_bits"), i) == 1, F.lit(0.0)).otherwise(s),
    )
    total = F.aggregate("masked", F.lit(0.0), lambda acc, x: acc + x)
    return (
        scored.withColumn("masked", masked)
        .withColumn("mass", total)
        .withColumn(
            "scores",
            F.when(F.col("mass") > 0, F.transform("masked", lambda x: x / F.col("mass")))
            .otherwise(F.col("masked")),
        )
        .drop("masked", "mass")
    )


def score_portfolio(scored: DataFrame, spec: PanelSpec) -> DataFrame:
    """Whole base: normalised scores over open items, propensity, list and outcome."""
    ready = with_recommendation(client_propensity(masked_renormalise(scored)), spec)
    return ready.select(
        "entity", "period", "prob_buy",
        (F.col("n_adds") > 0).cast("int").alias("took_up"), "recommended", "scores",
    )


def order_by_score(long: DataFrame, score: str = "score") -> DataFrame:
    """Candidates of each (entity, period) as one list by falling score."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("idx").alias("i"))))
    return (
        long.groupBy("entity", "period")
        .agg(pairs.alias("pairs"))
        .select("entity", "period", F.transform("pairs", lambda x: x["i"]).alias("ordered"))
    )


def with_ap(recommended: DataFrame, spec: PanelSpec, k: int | None = None) -> DataFrame:
    """AP@K of each row's list against its adds; rows without adds have nothing to hit."""
    ap = ap_at_k_bits(F.col("recommended"), F.col("add_bits"), k or spec.k)
    return recommended.filter(F.col("add_bits") != 0).withColumn("ap_micro", micro(ap))


def full_lists(scored: DataFrame) -> DataFrame:
    """Every item in score order, held ones included: the input of rank fusion."""
    return scored.withColumn("ordered", full_order(F.col("scores")))


def coverage_gap(train_ids: DataFrame, serve_ids: DataFrame, known: DataFrame, limit: float = 15.0) -> DataFrame:
    """Share of train and serve entities that have the joined-in feature, and the gap in points.

    Each side is reduced to distinct entities, then to four counts.
    """
    marked = known.select("entity").distinct().withColumn("is_known", F.lit(1))
    sides = (
        train_ids.select("entity").distinct().withColumn("side", F.lit("train"))
        .unionByName(serve_ids.select("entity").distinct().withColumn("side", F.lit("serve")))
    )
    counts = sides.join(marked, "entity", "left").agg(
        *[
            value.alias(f"{side}_{name}")
            for side in ("train", "serve")
            for name, value in (
                ("ids", F.count_if(F.col("side") == side)),
                ("covered", F.count_if((F.col("side") == side) & F.col("is_known").isNotNull())),
            )
        ]
    )
    share = {
        side: 100 * F.col(f"{side}_covered") / F.greatest(F.col(f"{side}_ids"), F.lit(1))
        for side in ("train", "serve")
    }
    return (
        counts.withColumns({f"{side}_pct": pct for side, pct in share.items()})
        .withColumn("gap", F.abs(F.col("train_pct") - F.col("serve_pct")))
        .withColumn("warn", F.col("gap") > limit)
    )


def drop_rates(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per (item, tenure): drops over rows holding the item, as two whole numbers."""
    return (
        explode_held(train, spec, keep=("period",))
        .groupBy("idx", "tenure")
        .agg(F.sum("label").alias("drops"), F.count("*").alias("rows"))
    )


def score_drops(held: DataFrame, rates: DataFrame) -> DataFrame:
    """Drop score of each held item from its (item, tenure) rate, and from its item alone.

    The rate table has catalogue x tenure rows, at most 62 x 7.
    """
    by_item = rates.groupBy("idx").agg(F.sum("drops").alias("item_drops"), F.sum("rows").alias("item_rows"))
    both = rates.join(by_item, "idx").select(
        "idx", "tenure",
        (F.col("drops") / F.col("rows")).alias("p"),
        (F.col("item_drops") / F.col("item_rows")).alias("p_item"),
    )
    return held.join(F.broadcast(both), ["idx", "tenure"], "left").withColumns(
        {"p": F.coalesce("p", F.lit(0.0)), "p_item": F.coalesce("p_item", F.lit(0.0))}
    )


def compare_approaches(ap: DataFrame, base: str) -> DataFrame:
    """MAP per model, its ratio to the base model, and the winner (ties: first name)."""
    means = mean_ap(ap, "model")
    everything = Window.partitionBy()  # one row per model
    base_sum = F.max(F.when(F.col("model") == base, F.col("ap_sum"))).over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("ap_sum"), "model"))
    return means.select(
        "model", "clients", "map",
        F.when(base_sum > 0, F.col("ap_sum") / base_sum).alias("ratio"),
        (place == 1).alias("winner"),
    )
