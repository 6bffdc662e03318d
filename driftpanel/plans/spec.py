"""Names and periods of one panel, passed to every plan."""

from __future__ import annotations

from dataclasses import dataclass

# The scenario sets and their display order.
SEASONS = ("Dormant_Season", "Growing_Season")
BUFFERS = (500, 1000, 2000)
ALL_SCENARIOS = tuple((s, b) for s in SEASONS for b in BUFFERS)
BLOCK_SCENARIOS = (
    ("Dormant_Season", 1000),
    ("Growing_Season", 500),
    ("Growing_Season", 1000),
    ("Growing_Season", 2000),
)
TRACT_SCENARIOS = (("Dormant_Season", 1000), ("Growing_Season", 1000))
SCENARIO_ORDER = (
    "Dormant 500 m",
    "Dormant 1000 m",
    "Dormant 2000 m",
    "Growing 500 m",
    "Growing 1000 m",
    "Growing 2000 m",
)
TRANSITIONS = ("Bright -> Bright", "Bright -> Dim", "Dim -> Bright", "Dim -> Dim")
QUARTILE_LABELS = ("Q1 (least)", "Q2", "Q3", "Q4 (most)")
GROWTH_LABELS = ("Q1 (least growth)", "Q2", "Q3", "Q4 (most growth)")


def tercile_labels(name: str) -> tuple[str, str, str]:
    return (f"Low {name}", f"Mid {name}", f"High {name}")


@dataclass(frozen=True)
class PanelSpec:
    """Column names, the two periods and the treatment of zero densities."""

    unit: str = "unit"
    season: str = "season"
    buffer: str = "buffer"
    period: str = "year"
    y: str = "ndvi"
    x: str = "hu_density"
    base: int = 2010
    target: int = 2020
    zero_policy: str = "floor"
    # Digits kept when a value decides a label or a bin; None compares raw values.
    label_digits: int | None = None

    @property
    def periods(self) -> tuple[int, int]:
        return (self.base, self.target)

    @property
    def strata(self) -> tuple[str, str]:
        return (self.season, self.buffer)

    @property
    def ids(self) -> tuple[str, str, str]:
        return (self.unit, self.season, self.buffer)

    @property
    def log_x(self) -> str:
        return f"log_{self.x}"

    @property
    def y_base(self) -> str:
        return f"{self.y}_{self.base}"

    @property
    def y_target(self) -> str:
        return f"{self.y}_{self.target}"

    @property
    def x_base(self) -> str:
        return f"{self.log_x}_{self.base}"

    @property
    def x_target(self) -> str:
        return f"{self.log_x}_{self.target}"
