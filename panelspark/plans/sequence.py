"""From features to scores of the whole base by the trajectory model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import clean, rankers, split
from panelspark.operators import recommend as rec
from panelspark.operators.trajectory import LENGTH
from panelspark.session import materialize
from panelspark.spec import PanelSpec

STATIC = ("adds_recent", "history")


def run_sequence(features: DataFrame, spec: PanelSpec, length: int = LENGTH, iterations: int = 60) -> DataFrame:
    """Static columns are standardised with train statistics; the portfolio of t comes out."""
    table = features.filter(F.col("period") <= spec.measured)
    scaled = clean.standardize(table.filter(F.col("period") < spec.decision), table, list(STATIC))
    rows = materialize(rankers.sequence_inputs(scaled, spec, length))
    parts = split.split_three(rows, spec.measured)
    fitted = rankers.fit_sequence(parts.train, spec, length, STATIC, iterations=iterations)
    return rec.score_portfolio(rankers.score_sequence(fitted, parts.measured, spec), spec)
