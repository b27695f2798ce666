"""Registration and oracle loading.

A query takes a ``Data``: one panel spec over one table folder.  ``_b`` keys run the same
query on the quarterly panel.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import features as feat
from panelspark.operators import recommend as rec
from panelspark.operators import reshape, split
from panelspark.session import materialize
from panelspark.sources import panels
from panelspark.spec import DAILY, QUARTERLY, PanelSpec

ORACLE_DIR = Path(__file__).resolve().parents[2] / "oracle"
MODULES = ("cleaning", "features", "recommend", "risk", "fusion", "models")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_PANEL: dict[str, PanelSpec] = {}


@dataclass(frozen=True)
class Data:
    spark: SparkSession
    folder: str
    spec: PanelSpec

    def table(self, name: str, *columns: str) -> DataFrame:
        return panels.table(self.spark, self.folder, name, *columns)

    @cached_property
    def panel(self) -> DataFrame:
        return panels.build_panel(self.spark, self.folder, self.spec)

    @cached_property
    def features(self) -> DataFrame:
        return feat.build_features(self.panel, self.spec)

    @cached_property
    def profile(self) -> DataFrame:
        return panels.customer_profile(self.spark, self.folder)

    def written(self) -> Data:
        """The same data with its feature table written once, for queries that read it often."""
        copy = Data(self.spark, self.folder, self.spec)
        until_now = self.features.filter(F.col("period") <= self.spec.measured)
        copy.__dict__["features"] = materialize(until_now)
        return copy

    @property
    def has_profile(self) -> bool:
        """Customers have attributes; the daily users have none."""
        return self.spec is QUARTERLY

    @cached_property
    def parts(self) -> split.ThreeWay:
        return split.split_three(self.features, self.spec.measured)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Rows of t-1 and t."""
        return self.features.filter(F.col("period").isin(self.spec.decision, self.spec.measured))

    @cached_property
    def by_rates(self) -> DataFrame:
        """Rows of t-1 and t with conditional add-rate scores learnt before t-1."""
        rates = rec.add_rates(self.parts.train, self.spec)
        return rec.score_by_band(self.evaluated, rates, self.spec)

    @cached_property
    def drop_scores(self) -> DataFrame:
        """Held items of t-1 and t with drop scores learnt before t-1."""
        held = reshape.explode_held(self.evaluated, self.spec)
        return rec.score_drops(held, rec.drop_rates(self.parts.train, self.spec))


def query(name: str, panel: str = "a"):
    """Register on panel a (daily), b (quarterly) or both; b keys get the suffix ``_b``."""

    def register(build: Callable[[Data], DataFrame]):
        for letter in panel:
            spec = {"a": DAILY, "b": QUARTERLY}[letter]
            key = name if letter == "a" else f"{name}_b"
            _QUERIES[key] = lambda spark, folder, spec=spec: build(Data(spark, folder, spec))
            _PANEL[key] = spec
        return build

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"panelspark.registry.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def _prelude(spec: PanelSpec) -> str:
    return (ORACLE_DIR / f"_{spec.name}.sql").read_text() + (ORACLE_DIR / "_shared.sql").read_text()


def oracle_sql() -> dict[str, str]:
    """``oracle/<name>.sql`` holds further CTEs and the final SELECT; the panel's CTEs go before.

    A file whose first line is ``-- standalone`` uses the tables directly.
    """
    _load()
    found = {}
    for key, spec in _PANEL.items():
        for stem in (key, key.removesuffix("_b")):
            path = ORACLE_DIR / f"{stem}.sql"
            if path.exists():
                body = path.read_text()
                standalone = body.startswith("-- standalone")
                found[key] = body if standalone else _prelude(spec) + body
                break
    return found
