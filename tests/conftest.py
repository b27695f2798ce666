from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from panelspark.session import local_session  # noqa: E402
from panelspark.spec import PanelSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "panelspark-tests", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Four items, lists of two, period 5 measured."""
    return PanelSpec("small", ("a", "b", "c", "d"), k=2, measured=5, season_length=12)


@pytest.fixture(scope="session")
def make_panel(spark, small):
    """Panel from {(entity, period): "ab"}; a value of None is an unknown state."""

    def build(states, spec=small):
        rows = [
            (e, p, None if held is None else sum(1 << spec.items.index(x) for x in held), len(held or ""))
            for (e, p), held in states.items()
        ]
        return spark.createDataFrame(rows, "entity long, period int, held long, activity long")

    return build
