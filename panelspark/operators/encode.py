"""Model inputs: which columns predict, and the Spark ML stages that turn them into a vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import has_item
from panelspark.operators.clean import flag_missing
from panelspark.spec import PanelSpec

COUNTERS = ("n_prev", "adds_recent", "drops_recent", "history", "season", "prev_activity")


@dataclass(frozen=True)
class Predictors:
    """Numeric columns are imputed and flagged, categories indexed, extras taken as they are."""

    numeric: tuple[str, ...] = COUNTERS
    categorical: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    def plus(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), extra: Sequence[str] = ()):
        return replace(
            self,
            numeric=(*self.numeric, *numeric),
            categorical=(*self.categorical, *categorical),
            extra=(*self.extra, *extra),
        )


def held_flags(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``held_0 .. held_n`` as doubles: what the entity held at t-1."""
    return df.withColumns(
        {f"held_{i}": has_item(F.col("prev_bits"), i).cast("double") for i in range(spec.n)}
    )


def held_names_of(spec: PanelSpec) -> tuple[str, ...]:
    return tuple(f"held_{i}" for i in range(spec.n))


def index_categories(columns: Sequence[str]) -> StringIndexer:
    """A category unseen in train gets an index of its own."""
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_index" for c in columns], handleInvalid="keep"
    )


def one_hot(columns: Sequence[str]) -> OneHotEncoder:
    """For linear models; trees read the nominal index and split on sets of categories."""
    return OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns],
        handleInvalid="keep",
    )


MEDIAN_ERROR = 0.0001  # of a rank: exact below some 5,000 rows, a sketch of bounded size above


def impute_median(columns: Sequence[str]) -> Imputer:
    return Imputer(
        inputCols=list(columns), outputCols=[f"{c}_filled" for c in columns], strategy="median",
        relativeError=MEDIAN_ERROR,
    )


def preprocess_stages(
    predictors: Predictors, invalid: str = "keep", with_one_hot: bool = False, impute: bool = True
) -> list:
    """Index, optionally encode, impute, assemble into ``features``.

    ``invalid="skip"`` with ``impute=False`` drops incomplete rows instead of filling them.
    Fold long-tailed categories first: the indexer keeps its labels on the driver.
    """
    stages, inputs = [], []
    if impute and predictors.numeric:
        stages.append(impute_median(predictors.numeric))
        inputs += [f"{c}_filled" for c in predictors.numeric]
        inputs += [f"{c}_missing" for c in predictors.numeric]
    else:
        inputs += list(predictors.numeric)
    inputs += list(predictors.extra)
    if predictors.categorical:
        stages.append(index_categories(predictors.categorical))
        if with_one_hot:
            stages.append(one_hot(predictors.categorical))
        suffix = "onehot" if with_one_hot else "index"
        inputs += [f"{c}_{suffix}" for c in predictors.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=invalid))
    return stages


def ready(df: DataFrame, predictors: Predictors) -> DataFrame:
    """Numeric columns as doubles with their missing flags, as the stages expect."""
    return flag_missing(df, predictors.numeric)
