"""Learnt models on the given tables (C9-C13, P3-P9, P12, P14, P15, B1-B7): rows only, no SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.functions import ap_at_k_bits, micro, names_of
from panelspark.operators import boosting, calibration, clean, drop, encode, fusion, metrics, rankers, reshape, split
from panelspark.operators import recommend as rec
from panelspark.operators.encode import COUNTERS, Predictors
from panelspark.operators.trajectory import LENGTH
from panelspark.registry.core import Data, query
from panelspark.session import dealt, materialize, new_shared_folder
from panelspark.sources import exports

CATEGORIES = ("segment", "province", "region")


def profiled(d: Data):
    """Feature rows with the customer profile, long-tailed provinces folded on train rows."""
    rows = d.features.join(d.profile, "entity", "left")
    train = rows.filter(F.col("period") < d.spec.decision)
    return clean.fold_rare(rows, "province", 20, learn_from=train)


def model_table(d: Data):
    """Feature rows with held flags, written once for the fits and scorings that follow."""
    rows = profiled(d) if d.has_profile else d.features
    table = materialize(encode.held_flags(rows, d.spec).filter(F.col("period") <= d.spec.measured))
    return dealt(table, "entity", "period")


def predictors(d: Data) -> Predictors:
    base = Predictors(extra=encode.held_names_of(d.spec))
    return base.plus(numeric=("income",), categorical=CATEGORIES) if d.has_profile else base


def list_report(scored, d: Data):
    """Per entity of t: list, AP in millionths, and whether anything was taken up."""
    listed = rec.with_recommendation(scored, d.spec) if "recommended" not in scored.columns else scored
    ap = micro(ap_at_k_bits(F.col("recommended"), F.col("add_bits"), d.spec.k))
    return listed.select(
        "entity", "period",
        F.array_join(names_of(F.col("recommended"), d.spec.items), ",").alias("recommended"),
        F.when(F.col("add_bits") != 0, ap).alias("ap_micro"),
    )


def parts(table, d: Data):
    return split.split_three(table, d.spec.measured)


@query("c9_imputer_model", "b")
def _(d: Data):
    rows = clean.flag_missing(profiled(d), ["income", "prev_activity"])
    train = rows.filter(F.col("period") < d.spec.decision)
    return encode.impute_median(["income", "prev_activity"]).fit(train).transform(rows).select(
        "entity", "period", "income_filled", "income_missing", "prev_activity_filled"
    )


@query("c10_index_categories_model", "b")
def _(d: Data):
    rows = profiled(d)
    train = rows.filter(F.col("period") < d.spec.decision)
    indexed = encode.index_categories(CATEGORIES).fit(train).transform(rows)
    return indexed.select("entity", "period", *[f"{c}_index" for c in CATEGORIES])


@query("c11_one_hot_model", "b")
def _(d: Data):
    rows = profiled(d)
    stages = [encode.index_categories(CATEGORIES), encode.one_hot(CATEGORIES)]
    coded = Pipeline(stages=stages).fit(rows.filter(F.col("period") < d.spec.decision)).transform(rows)
    return coded.select(
        "entity", "period",
        *[F.array_join(vector_to_array(f"{c}_onehot"), ",").alias(f"{c}_onehot") for c in CATEGORIES],
    )


def assembled(d: Data, **options):
    table, inputs = model_table(d), predictors(d)
    train = encode.ready(parts(table, d).train, inputs)
    stages = Pipeline(stages=encode.preprocess_stages(inputs, **options)).fit(train)
    return stages.transform(encode.ready(table, inputs)).select(
        "entity", "period", F.array_join(vector_to_array("features"), ",").alias("features")
    )


@query("c12_assemble_model", "ab")
def _(d: Data):
    return assembled(d)


@query("c13_assemble_skip_model", "b")
def _(d: Data):
    return assembled(d, invalid="skip", with_one_hot=True, impute=False)


@query("s8_model_reload", "ab")
def _(d: Data):
    """Scores of a fitted drop model before it is saved and after it is loaded again."""
    long, inputs = drop_table(d)
    part = parts(long, d)
    model = drop.fit_drop_model(part.train, inputs, trees=3, depth=3)
    path = new_shared_folder(d.spark, "model")
    exports.save_model(model, path)
    before, after = (
        drop.score_binary(m, part.measured, inputs, name).select("entity", "item", name)
        for m, name in ((model, "before"), (exports.load_model(path), "after"))
    )
    both = before.join(after, ["entity", "item"])
    return both.agg(F.count("*").alias("rows"), F.bool_and(F.col("before") == F.col("after")).alias("equal"))


def als_of(d: Data, train):
    return rankers.fit_als(reshape.interaction_counts(train, d.spec, "held"))


@query("p3_als_model", "ab")
def _(d: Data):
    """Item factors of the fitted model."""
    factors = als_of(d, materialize(d.parts.train)).model.itemFactors
    return factors.select(F.col("id").alias("idx"), F.array_join("features", ",").alias("factors"))


@query("p4_recommend_als_model", "ab")
def _(d: Data):
    part = parts(model_table(d), d)
    return list_report(rankers.recommend_als(als_of(d, part.train), part.measured, d.spec), d)


@query("p5_user_factors_model", "ab")
def _(d: Data):
    return rankers.user_factors(als_of(d, materialize(d.parts.train)))


def multiclass_report(d: Data, kind: str, inputs: Predictors | None = None, **size):
    part, inputs = parts(model_table(d), d), inputs or predictors(d)
    fitted = rankers.fit_multiclass(part.train, inputs, d.spec, kind, **size)
    return list_report(rankers.score_multiclass(fitted, part.measured, d.spec), d)


@query("p7_forest_model", "ab")
def _(d: Data):
    return multiclass_report(d, "forest")


@query("p8_boosted_model", "ab")
def _(d: Data):
    return multiclass_report(d, "boosted")


@query("p8_logistic_model", "ab")
def _(d: Data):
    return multiclass_report(d, "logistic")


@query("p9_hybrid_model", "ab")
def _(d: Data):
    table = model_table(d)
    factors = rankers.user_factors(als_of(d, parts(table, d).train))
    part = parts(materialize(table.join(factors, "entity", "left")), d)
    inputs = predictors(d).plus(numeric=rankers.factor_names())
    fitted = rankers.fit_multiclass(part.train, inputs, d.spec, "boosted")
    return list_report(rankers.score_multiclass(fitted, part.measured, d.spec), d)


@query("p12_ranker_model", "ab")
def _(d: Data):
    part = parts(model_table(d), d)
    ranker = rankers.fit_listwise(part.train, predictors(d), d.spec)
    return list_report(rankers.score_listwise(ranker, part.measured, d.spec), d)


@query("p12_linear_ranker_model", "ab")
def _(d: Data):
    part = parts(model_table(d), d)
    ranker = rankers.fit_ranker(part.train, d.spec)
    return list_report(rankers.score_ranker(ranker, part.measured), d)


ROOT_COUNTS = ("n_prev", "adds_recent", "drops_recent", "history", "season")
ROOT_CUTS = tuple(float(c) for c in range(31))  # counts from 31 on share the last bin


@query("p8_gradient_sums", "ab")
def _(d: Data):
    """What the first split of every item's first tree is chosen from."""
    names = (*ROOT_COUNTS, *encode.held_names_of(d.spec))
    held = encode.held_flags(d.parts.train, d.spec)
    adds = reshape.explode_adds(held, d.spec, keep=("entity", "period", *names))
    vectors = adds.withColumn("x", F.array(*[F.col(c).cast("double") for c in names]))
    binning = boosting.Binning((ROOT_CUTS,) * len(names))
    rows = boosting.examples(vectors, binning, "x", F.array("idx"), outputs=d.spec.n)
    sums = boosting.root_sums(materialize(rows), binning, d.spec.n, boosting.softmax_gradients)
    label = [F.get(F.array(*[F.lit(v) for v in values]), c) for values, c in ((d.spec.items, "tree"), (names, "feature"))]
    return sums.select(label[0].alias("item"), label[1].alias("feature"), "bin", "gradient", "hessian")


@query("p12_lambdas", "ab")
def _(d: Data):
    """Gradients of the listwise ranker that starts from conditional add rates, per candidate of t-1 and t."""
    lists = rankers.ranking_lists(d.by_rates, d.spec, d.spec.negatives, "entity", "period", "scores")
    started = lists.withColumn("start", F.transform("items", lambda i: F.get("scores", i)))
    item = F.get(F.array(*[F.lit(v) for v in d.spec.items]), "idx").alias("item")
    return boosting.listed_gradients(started).select("entity", "period", item, "label", "gradient", "hessian")


@query("p14_profile_only_model", "b")
def _(d: Data):
    """No item column and no history: what can be said about a newcomer."""
    inputs = Predictors(numeric=("season", "income"), categorical=CATEGORIES)
    return multiclass_report(d, "forest", inputs)


@query("p15_sequence_model", "ab")
def _(d: Data):
    table = clean.standardize(d.parts.train, d.features, ["adds_recent", "history"])
    rows = materialize(
        rankers.sequence_inputs(table.filter(F.col("period") <= d.spec.measured), d.spec, LENGTH)
    )
    part = parts(rows, d)
    fitted = rankers.fit_sequence(part.train, d.spec, LENGTH, static=("adds_recent", "history"))
    return list_report(rankers.score_sequence(fitted, part.measured, d.spec), d)


def drop_table(d: Data):
    """Held-item rows with the predictors, and the predictors of the drop model."""
    inputs = predictors(d)
    table = encode.held_flags(profiled(d) if d.has_profile else d.features, d.spec)
    keep = ("entity", "period", *inputs.numeric, *inputs.categorical, *inputs.extra)
    long = reshape.explode_held(table.filter(F.col("period") <= d.spec.measured), d.spec, keep)
    return dealt(materialize(long), "entity", "period"), inputs.plus(numeric=("tenure",), categorical=("item",))


def drop_scored(d: Data):
    long, inputs = drop_table(d)
    part = parts(long, d)
    model = drop.fit_drop_model(part.train, inputs)
    return tuple(
        drop.score_binary(model, rows, inputs).select("entity", "period", "item", "label", "p_raw")
        for rows in (part.decision, part.measured)
    )


@query("b1_drop_model", "ab")
def _(d: Data):
    _, measured = drop_scored(d)
    return measured


@query("b2_calibrated_drop_model", "ab")
def _(d: Data):
    decision, measured = drop_scored(d)
    calibrated = materialize(drop.calibrate(decision, measured))
    quality = metrics.brier(calibrated, "p_raw", "p").withColumn("one", F.lit(1))
    ties = metrics.tie_levels(calibrated, "p").select(F.lit(1).alias("one"), "levels")
    return quality.join(F.broadcast(ties), "one").drop("one")


@query("b3_leakage_control_model", "ab")
def _(d: Data):
    return drop.leakage_control(model_table(d), d.panel, d.spec, predictors(d), d.spec.measured)


def newest_rows(d: Data):
    """One row per customer: the newest usable one, with its profile; counters are 0 without one."""
    newest = d.features.groupBy("entity").agg(
        F.max_by(F.struct("period", *COUNTERS), "period").alias("row")
    )
    rows = d.profile.join(newest.select("entity", "row.*"), "entity", "left")
    return rows.na.fill(0, list(COUNTERS))


@query("b4_missingness_model", "b")
def _(d: Data):
    inputs = Predictors(numeric=COUNTERS, categorical=CATEGORIES)
    return drop.missingness_model(newest_rows(d), "income", inputs)[0]


@query("b5_grouped_importance_model", "b")
def _(d: Data):
    inputs = Predictors(numeric=COUNTERS, categorical=CATEGORIES)
    return drop.missingness_model(newest_rows(d), "income", inputs)[1]


@query("b6_compare_imputation_model", "b")
def _(d: Data):
    inputs = Predictors(numeric=COUNTERS, categorical=CATEGORIES)
    return drop.compare_imputation(newest_rows(d), "income", inputs)


@query("b7_drift_curve_model", "ab")
def _(d: Data):
    long, inputs = drop_table(d)
    periods = split.first_periods(long)
    return drop.drift_curve(long, inputs, periods, window=4)


# --- what every fitted model must keep, as rows that SQL can state ----------------------------

def list_properties(scored, d: Data, probabilities: bool = True):
    """Rows, held or repeated items in lists, wrong list lengths, and whether the scores are fit to rank."""
    listed = rec.with_recommendation(scored, d.spec) if "recommended" not in scored.columns else scored
    held = F.exists("recommended", lambda i: F.getbit("prev_bits", i) == 1)
    open_items = d.spec.n - F.bit_count("prev_bits")
    fit = F.size("scores") == d.spec.n
    fit = fit & F.forall("scores", lambda v: (v >= 0) & (v <= 1 + 1e-9) if probabilities else ~F.isnan(v))
    return listed.agg(
        F.count("*").alias("rows"),
        F.count_if(held | (F.size(F.array_distinct("recommended")) < F.size("recommended"))).alias("wrong_items"),
        F.count_if(F.size("recommended") != F.least(F.lit(d.spec.k), open_items)).alias("wrong_length"),
        F.bool_and(F.coalesce(fit, F.lit(False))).alias("scores_fit"),
    )


def multiclass_properties(d: Data, kind: str, inputs: Predictors | None = None):
    part, inputs = parts(model_table(d), d), inputs or predictors(d)
    fitted = rankers.fit_multiclass(part.train, inputs, d.spec, kind)
    return list_properties(rankers.score_multiclass(fitted, part.measured, d.spec), d)


@query("p3_als_factors", "ab")
def _(d: Data):
    """Items that have a factor, all of it nonnegative and of the wanted length."""
    factors = als_of(d, materialize(d.parts.train)).model.itemFactors
    good = (F.size("features") == rankers.ALS_RANK) & F.forall("features", lambda v: v >= 0)
    return factors.select(F.col("id").alias("idx"), good.alias("good"))


@query("p4_als_lists", "ab")
def _(d: Data):
    """Whether an entity of t gets a list at all, and whether it lists a held item."""
    part = parts(model_table(d), d)
    listed = rankers.recommend_als(als_of(d, part.train), part.measured, d.spec)
    held = F.exists("recommended", lambda i: F.getbit("prev_bits", i) == 1)
    return listed.select("entity", F.col("scores").isNotNull().alias("known"), held.alias("lists_held"))


@query("p5_user_vectors", "ab")
def _(d: Data):
    vectors = rankers.user_factors(als_of(d, materialize(d.parts.train)))
    good = F.forall(F.array(*rankers.factor_names()), lambda v: v >= 0)
    return vectors.select("entity", good.alias("good"))


@query("p7_forest_properties", "ab")
def _(d: Data):
    return multiclass_properties(d, "forest")


@query("p8_boosted_properties")
def _(d: Data):
    return multiclass_properties(d, "boosted")


@query("p9_hybrid_properties")
def _(d: Data):
    """The hybrid against the same model without factors: its lists hold to the same rules."""
    table = model_table(d)
    factors = rankers.user_factors(als_of(d, parts(table, d).train))
    part = parts(materialize(table.join(factors, "entity", "left")), d)
    fitted = rankers.fit_multiclass(part.train, predictors(d).plus(numeric=rankers.factor_names()), d.spec, "boosted")
    return list_properties(rankers.score_multiclass(fitted, part.measured, d.spec), d)


@query("p12_ranker_properties")
def _(d: Data):
    part = parts(model_table(d), d)
    ranker = rankers.fit_listwise(part.train, predictors(d), d.spec)
    return list_properties(rankers.score_listwise(ranker, part.measured, d.spec), d, probabilities=False)


@query("p14_profile_only_properties", "b")
def _(d: Data):
    return multiclass_properties(d, "forest", Predictors(numeric=("season", "income"), categorical=CATEGORIES))


@query("p15_sequence_properties", "ab")
def _(d: Data):
    table = clean.standardize(d.parts.train, d.features, ["adds_recent", "history"])
    rows = materialize(rankers.sequence_inputs(table.filter(F.col("period") <= d.spec.measured), d.spec, LENGTH))
    part = parts(rows, d)
    fitted = rankers.fit_sequence(part.train, d.spec, LENGTH, static=("adds_recent", "history"))
    return list_properties(rankers.score_sequence(fitted, part.measured, d.spec), d)


@query("b1_drop_properties", "ab")
def _(d: Data):
    _, measured = drop_scored(d)
    return measured.select("entity", "item", F.col("label").cast("int").alias("label"), F.col("p_raw").between(0, 1).alias("probability"))


@query("b2_calibration_properties", "ab")
def _(d: Data):
    """Points of the map, steps downwards, and values outside [0, 1]."""
    decision, _ = drop_scored(d)
    found = materialize(calibration.calibration_map(calibration.isotonic_blocks(calibration.calibration_points(decision, "p_raw"))))
    following = found.select((F.col("point") - 1).alias("point"), F.col("p").alias("next"))
    return found.join(following, "point", "left").agg(
        F.count("*").alias("points"), F.count_if(F.col("next") < F.col("p")).alias("downwards"),
        F.count_if(~F.col("p").between(0, 1)).alias("outside"),
    )


@query("b4_missingness_properties", "b")
def _(d: Data):
    inputs = Predictors(numeric=COUNTERS, categorical=CATEGORIES)
    summary = drop.missingness_model(newest_rows(d), "income", inputs)[0]
    return summary.select("missing_rate", F.col("auc").between(0, 1).alias("auc_fit"), F.col("verdict").isNotNull().alias("judged"))


@query("b5_importance_properties", "b")
def _(d: Data):
    """Every source column with its weight; they add up to one."""
    inputs = Predictors(numeric=COUNTERS, categorical=CATEGORIES)
    weights = drop.missingness_model(newest_rows(d), "income", inputs)[1]
    return weights.agg(
        F.count("*").alias("sources"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("whole"), F.count_if(F.col("importance") < 0).alias("negative")
    )


# --- learnt models in fusion and routing ------------------------------------------------------

LEARNT = ("popularity", "als", "forest", "pairwise")


def learnt_rows(d: Data):
    """Rows of t-1 and t with the scores of popularity and of models learnt before t-1, written once."""
    table, inputs = model_table(d), predictors(d)
    part = parts(table, d)
    als, forest = als_of(d, part.train), rankers.fit_multiclass(part.train, inputs, d.spec, "forest")
    pairwise = rankers.fit_ranker(part.train, d.spec)
    rows = table.filter(F.col("period").isin(d.spec.decision, d.spec.measured))
    scored = rankers.side_by_side(rec.with_model_scores(rows, part.train, d.spec), d.spec, {
        "als": lambda r: rankers.score_als(als, r, d.spec),
        "forest": lambda r: rankers.score_multiclass(forest, r, d.spec),
        "pairwise": lambda r: rankers.score_ranker(pairwise, r),
    })
    return materialize(scored)


def learnt_ap(d: Data, rows, models=LEARNT):
    return fusion.ap_by_client(rows, models, d.spec, keep=("history", "n_prev"))


@query("u3_learnt_winners_model", "ab")
def _(d: Data):
    ap = fusion.with_segment(learnt_ap(d, learnt_rows(d)), "history", fusion.HISTORY_BANDS)
    return fusion.segment_winners(ap, ("period", "segment"))


@query("u3_learnt_segments", "ab")
def _(d: Data):
    """Every segment is won by one of the models, counted on the clients it has."""
    ap = fusion.with_segment(learnt_ap(d, learnt_rows(d)), "history", fusion.HISTORY_BANDS)
    won = fusion.segment_winners(ap, ("period", "segment"))
    return won.select("period", "segment", "clients", F.col("winner").isin(*LEARNT).alias("known"))


@query("u4_learnt_route_model", "ab")
def _(d: Data):
    """The rule of t-1 over learnt models applied on t, and its gain over the best single one."""
    ap = fusion.with_segment(learnt_ap(d, learnt_rows(d)), "n_prev", fusion.HOLDING_BANDS)
    return fusion.routing_gain(ap, d.spec.measured)


@query("e4_learnt_blend_model", "ab")
def _(d: Data):
    """Weights found on t-1 for the learnt models, and the blend's gain on t."""
    rows = learnt_rows(d)
    ranked = {p: fusion.with_rank_arrays(rows.filter(F.col("period") == p), LEARNT) for p in (d.spec.decision, d.spec.measured)}
    chosen = fusion.search_weights(ranked[d.spec.decision], LEARNT, d.spec)
    measured = ranked[d.spec.measured]
    blended = rec.with_ap(fusion.blend_with(measured, chosen, LEARNT, d.spec), d.spec)
    ap = fusion.ap_by_client(measured, LEARNT, d.spec).select("model", "ap_micro")
    return fusion.blend_gain(ap.unionByName(blended.select(F.lit("blend").alias("model"), "ap_micro")))


@query("p14_history_bands_model", "b")
def _(d: Data):
    """MAP per history band of the profile-only model, the whole forest and popularity, and who wins."""
    table = model_table(d)
    part = parts(table, d)
    newcomer = Predictors(numeric=("season", "income"), categorical=CATEGORIES)
    fitted = {name: rankers.fit_multiclass(part.train, p, d.spec, "forest") for name, p in (("profile", newcomer), ("forest", predictors(d)))}
    rows = rec.with_model_scores(part.measured, part.train, d.spec)
    scorers = {n: (lambda r, m=m: rankers.score_multiclass(m, r, d.spec)) for n, m in fitted.items()}
    rows = materialize(rankers.side_by_side(rows, d.spec, scorers))
    ap = fusion.with_segment(learnt_ap(d, rows, ("popularity", *fitted)), "history", fusion.HISTORY_BANDS)
    means = split.mean_ap(ap, "segment", "model").select("segment", "model", "clients", "map")
    best = fusion.segment_winners(ap).select("segment", F.col("winner").alias("model"), F.lit(True).alias("winner"))
    return means.join(best, ["segment", "model"], "left").na.fill(False, ["winner"])
