"""All thresholds and choices of a linkage run in one place."""

from __future__ import annotations

from dataclasses import dataclass

from .operators.features import FEATURES


def grid(low: float, high: float, step: float = 0.05) -> list[float]:
    """Thresholds from ``low`` to ``high``, both included, in two decimals."""
    return [round(low + step * i, 2) for i in range(round((high - low) / step) + 1)]


@dataclass(frozen=True)
class Config:
    """Defaults are those of the reference settings, but for the size of the boosted trees."""

    # blocking
    top_k: int = 2
    top_k_nostate: int = 3
    second: float = 0.8
    floor: float = 0.10
    name_weight: float = 0.5
    name_max_df: float = 0.05
    addr_max_df: float = 0.05
    small: int = 5000
    smallest_partitions: int | None = None
    # learned words and places
    dict_votes: int = 2
    dict_share: float = 0.5
    city_votes: int = 30
    city_purity: float = 0.97
    # pair model
    features: tuple[str, ...] = tuple(FEATURES)
    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    min_leaf: int = 5
    subsample: float = 0.8
    seed: int = 7
    models: str | None = None
    retrain: bool = False
    # entity model and decisions
    anchor: float = 0.9
    use_ce: bool = True
    band: tuple[float, float] = (0.02, 0.98)
    pair_grid: tuple[float, ...] = tuple(grid(0.60, 0.75))
    entity_grid: tuple[float, ...] = tuple(grid(0.50, 0.80))
    unseen: float | None = None
    # robustness
    sample_pairs: int = 2_000_000
    country_sensitive: tuple[str, ...] = ("name_freq", "addr_freq", "legal_eq", "legal_conflict")
