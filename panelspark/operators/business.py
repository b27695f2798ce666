"""From scores to a contact plan: capture curve, quadrants, actions, call list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.metrics import cumulative_histogram, exact_cuts

# fixed values: contacted shares of the capture curve, in thousandths
CAPTURE_POINTS = (10, 20, 50, 100, 200, 500)
# fixed values: cut percentile for both axes of the quadrants, in thousandths
QUADRANT_CUT = 800
# fixed values: quadrant names and what to do in each
SELL, RETAIN_FIRST, RETAIN, LEAVE = "VENDER", "RETENER PRIMERO", "RETENER", "NO TOCAR"
ACTIONS = {
    SELL: "offer the next product",
    RETAIN_FIRST: "retain before selling anything",
    RETAIN: "retention campaign",
    LEAVE: "spend no contact this period",
}


def capture_curve(df: DataFrame, score: str, hit: str, points=CAPTURE_POINTS) -> DataFrame:
    """Share of hits reached by contacting the best x percent; ties at the cut all count."""
    cuts = exact_cuts(cumulative_histogram(df, score, hit), [1000 - p for p in points])
    entries = F.array(
        *[
            F.struct(F.lit(p / 10).alias("pct_base"), F.col(f"cut_{1000 - p}").alias("cut"))
            for p in points
        ]
    )
    rows = cuts.select("all_n", "all_pos", F.inline(entries))
    captured = 100 * F.col("cut.pos_from") / F.greatest("all_pos", F.lit(1))
    reached = 100 * F.col("cut.rows_from") / F.greatest("all_n", F.lit(1))
    return rows.select(
        "pct_base",
        F.col("cut.rows_from").alias("contacted"),
        F.col("cut.pos_from").alias("hits"),
        reached.alias("pct_contacted"),
        captured.alias("pct_captured"),
        (captured / reached).alias("multiplier"),
    )


def client_risk(drop_scores: DataFrame, score: str = "p") -> DataFrame:
    """An entity's risk is its riskiest item."""
    return drop_scores.groupBy("entity").agg(F.max(score).alias("prob_drop"))


def with_risk(purchase: DataFrame, risk: DataFrame) -> DataFrame:
    """Purchase scores with risk; an entity without a risk row has risk 0."""
    return purchase.join(risk, "entity", "left").fillna({"prob_drop": 0.0})


def percentile_cuts(df: DataFrame, columns: list[str], per_mille: int = QUADRANT_CUT) -> DataFrame:
    """One row of exact cuts, one column per score."""
    cuts = None
    for column in columns:
        one = exact_cuts(
            cumulative_histogram(df.withColumn("zero", F.lit(0)), column, "zero"), [per_mille]
        ).select(F.lit(1).alias("one"), F.col(f"cut_{per_mille}.score").alias(f"cut_{column}"))
        cuts = one if cuts is None else cuts.join(F.broadcast(one), "one")
    return cuts.drop("one")


def approximate_cuts(df: DataFrame, columns: list[str], per_mille: int = QUADRANT_CUT, error: float = 0.01):
    """The cheaper one-pass variant for very large bases."""
    return [c[0] for c in df.approxQuantile(columns, [per_mille / 1000], error)]


SKETCH_K = 800  # of the quantile sketches: about 0.4 percent rank error, some 10 kB each


def score_sketches(df: DataFrame, columns: list[str], by: str = "period", k: int = SKETCH_K) -> DataFrame:
    """(by, n, sketch_<column>): one mergeable quantile sketch per period and score, in one scan.

    Store the result: later cuts, of any percentile and any set of periods, merge sketches and
    do not read the scores again.
    """
    sketches = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"sketch_{c}") for c in columns]
    return df.groupBy(by).agg(F.count("*").alias("n"), *sketches)


def sketch_cuts(sketches: DataFrame, columns: list[str], per_mille: list[int], by: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """(by, score, per_mille, cut): approximate percentiles per period, or of all periods merged."""
    merged = [F.kll_merge_agg_double(F.col(f"sketch_{c}"), k).alias(f"sketch_{c}") for c in columns]
    whole = sketches.groupBy(*([by] if by else [])).agg(*merged)
    asked = F.array(*[
        F.struct(F.lit(c).alias("score"), F.lit(q).alias("per_mille"), F.kll_sketch_get_quantile_double(F.col(f"sketch_{c}"), F.lit(q / 1000)).alias("cut"))
        for c in columns for q in per_mille
    ])
    known = F.lit(True)
    for c in columns:
        known = known & F.col(f"sketch_{c}").isNotNull()
    return whole.filter(known).select(*([by] if by else []), F.inline(asked))


def quadrant_of(buy: Column, risk: Column, cut_buy: Column, cut_risk: Column) -> Column:
    return (
        F.when((buy >= cut_buy) & (risk >= cut_risk), RETAIN_FIRST)
        .when(buy >= cut_buy, SELL)
        .when(risk >= cut_risk, RETAIN)
        .otherwise(LEAVE)
    )


def with_quadrant(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` is the one-row result of ``percentile_cuts``."""
    return (
        df.withColumn("one", F.lit(1))
        .join(F.broadcast(cuts.withColumn("one", F.lit(1))), "one")
        .withColumn(
            "quadrant",
            quadrant_of(F.col("prob_buy"), F.col("prob_drop"), F.col("cut_prob_buy"), F.col("cut_prob_drop")),
        )
        .drop("one", "cut_prob_buy", "cut_prob_drop")
    )


def quadrants(df: DataFrame) -> DataFrame:
    """Entities per quadrant with their share."""
    counts = df.groupBy("quadrant").agg(F.count("*").alias("clients"))
    total = counts.agg(F.sum("clients").alias("total")).withColumn("one", F.lit(1))
    return (
        counts.withColumn("one", F.lit(1))
        .join(F.broadcast(total), "one")
        .select("quadrant", "clients", (100 * F.col("clients") / F.col("total")).alias("pct"))
    )


def with_action(df: DataFrame) -> DataFrame:
    """Join the four-row action table."""
    table = df.sparkSession.createDataFrame(list(ACTIONS.items()), "quadrant string, action string")
    return df.join(F.broadcast(table), "quadrant")


def call_list(scores: DataFrame, n: int) -> DataFrame:
    """The n most likely buyers that have something to be offered: a distributed top-n."""
    return (
        scores.filter(F.size("recommended") > 0)
        .orderBy(F.desc("prob_buy"), "entity")
        .limit(n)
    )
