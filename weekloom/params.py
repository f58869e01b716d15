"""All parameters of the jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    horizon: int = 10
    eval_horizon: int = 8
    excluded: tuple[int, ...] = (2019, 2020, 2021)
    min_seasons: int = 4
    min_n: int = 3
    # models
    momentum_phi: float = 0.6
    momentum_k: int = 2
    anomaly_rho: float = 0.92
    profile_n: int = 3
    profile_phi: float = 0.0
    profile_clip: float = 0.35
    recent_effects_from: int = 2024
    shape_weeks: int = 6
    min_pairs: int = 3
    min_long_pairs: int = 13
    decay: float = 0.7
    nearest: int = 30
    tau: float = 0.25
    long_weeks: int = 104
    analog_rho: float = 0.80
    blend: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    # errors and forecasts
    phase_window: int = 6
    min_pool: int = 60
    recent_weight: float = 3.0
    recent_from: int = 2022
    widen: float = 1.15
    tune: tuple[int, int] = (2012, 2018)
    holdout: tuple[int, int] = (2022, 2025)
    thresholds: tuple[float, float, float] = (750.0, 1000.0, 1500.0)
    # history
    ratio: float = 1.20
    sub_ratio: float = 1.163
    gate: tuple[float, float] = (0.4, 2.5)
    revision: float = 0.02
    plausible: tuple[float, float] = (50.0, 5000.0)
    signal: float = 25.0


#: For the orders table: seasons 1994 to 2001, one of them left out.
ORDERS = replace(Params(), excluded=(1997,), recent_effects_from=1999, recent_from=2000, tune=(1998, 1999), holdout=(2000, 2001), plausible=(1.0, 1e9), phase_window=6, min_pool=20)
