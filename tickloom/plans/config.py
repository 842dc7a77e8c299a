"""Settings of an experiment."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: The 78 underlyings that are kept by default: members of a large-cap index, as the specification of the experiment lists them.
UNDERLYINGS = tuple(Path(__file__).with_name("underlyings.txt").read_text().split())
CONTRACT_DAY = ("date", "underlying", "expiry", "cp_flag", "strike")
#: Edges, in seconds, of nine spans of history that follow each other.
EDGES = (0, 5, 10, 20, 40, 80, 120, 180, 240, 300)


@dataclass(frozen=True)
class Settings:
    underlyings: tuple[str, ...] = UNDERLYINGS
    spans: tuple[tuple[float, float], ...] = tuple(zip(EDGES, EDGES[1:]))
    groups: tuple[str, ...] = CONTRACT_DAY
    dte: tuple[int, int] = (0, 14)
    caps: tuple[float, ...] = (0.08, 0.10, 0.12)
    horizons: tuple[int, ...] = (5, 10, 30, 60, 90, 120)
    top_contracts: int = 50
    same_exchange: bool = True
    train_minutes: int = 30
    refit_minutes: int = 5
    min_labels: int = 20
    min_train_rows: int = 200
    min_rows: int = 100
    models: tuple[str, ...] = ("Lasso", "Ridge", "ElasticNet", "RandomForest", "XGBoost")
    include_lambda: bool = False  # the select pattern misses these features
    sum_quote_sizes: bool = True  # simultaneous trades add up their quotes' sizes
    purge_label_overlap: bool = False  # labels of the last training rows look into the test window
    tick: int = 1_000_000_000  # ticks of the time key in a second
    extra: dict = field(default_factory=dict)
