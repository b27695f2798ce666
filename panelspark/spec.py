"""What a panel is about: its catalogue, list length and measured period."""

from __future__ import annotations

from dataclasses import dataclass

MAX_ITEMS = 62  # one bit per item in a signed BIGINT


@dataclass(frozen=True)
class PanelSpec:
    """Catalogue order is the order of ``items``; it breaks every ranking tie."""

    name: str
    items: tuple[str, ...]
    k: int
    measured: int
    season_length: int
    negatives: int = 6  # sampled open items a row of a ranking group

    def __post_init__(self) -> None:
        if not 0 < len(self.items) <= MAX_ITEMS:
            raise ValueError(f"a panel catalogue has 1..{MAX_ITEMS} items, got {len(self.items)}")
        if len(set(self.items)) != len(self.items):
            raise ValueError("catalogue items must be distinct")

    @property
    def n(self) -> int:
        return len(self.items)

    @property
    def decision(self) -> int:
        """The period on which every choice is made; ``measured`` only reports it."""
        return self.measured - 1


# Daily activity per user, and quarterly brand purchases per customer.
DAILY = PanelSpec(
    "daily", ("click", "error", "purchase", "signup", "view"), k=3, measured=29, season_length=7, negatives=2
)
QUARTERLY = PanelSpec(
    "quarterly", tuple(f"Brand#{i}" for i in range(1, 26)), k=7, measured=25, season_length=4
)
