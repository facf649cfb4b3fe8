"""Cleaning and smoothing of regular per-pixel series (pixel_id, k, t, v).

``t`` is the day number of composite k; missing values are null.  Ties are
always resolved to the first index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from verdure.config import Phenology
from verdure.operators.layers import AFTER, BEFORE, PIXEL, SERIES, Layers, apply


def observation_layers() -> Layers:
    """n_obs, first_obs, last_obs, n_k and the gap to the valid composite before."""
    seen = "CASE WHEN v IS NOT NULL THEN k END"
    before = f"max({seen}) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        {"n_obs": f"count(v) {PIXEL}", "n_k": f"count(*) {PIXEL}", "first_obs": f"min({seen}) {PIXEL}", "last_obs": f"max({seen}) {PIXEL}", "seen_before": before},
        {"max_gap": f"max(CASE WHEN v IS NOT NULL AND seen_before IS NOT NULL THEN k - seen_before ELSE 0 END) {PIXEL}", "last_obs_day": f"max(CASE WHEN v IS NOT NULL THEN t END) {PIXEL}"},
    ]


def fill_layers(source: str, out: str) -> Layers:
    """Linear by index between neighbours, the nearest value beyond the ends; without any value null."""
    seen = f"CASE WHEN {source} IS NOT NULL THEN k END"
    a, b = f"{out}_a", f"{out}_b"
    return [
        {a: f"LAST_OF({source} SKIP_NULLS) {BEFORE}", f"{a}k": f"max({seen}) {BEFORE}", b: f"FIRST_OF({source} SKIP_NULLS) {AFTER}", f"{b}k": f"min({seen}) {AFTER}"},
        {out: f"CASE WHEN {source} IS NOT NULL THEN {source} WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {a} + ({b} - {a}) * (k - {a}k) / ({b}k - {a}k) END"},
    ]


def despike_layers(source: str, filled: str, out: str, c: Phenology) -> Layers:
    """Drops single dips between vegetated neighbours; never the two ends."""
    p, n = f"{out}_p", f"{out}_n"
    dip = f"{p} IS NOT NULL AND {n} IS NOT NULL AND least({p}, {n}) > {c.despike_neighbour} AND {filled} < ({p} + {n}) / 2 - {c.despike_drop}"
    return [{p: f"lag({filled}) OVER ({SERIES})", n: f"lead({filled}) OVER ({SERIES})"}, {out: f"CASE WHEN {dip} THEN NULL ELSE {source} END"}]


def smoothing_matrix(window: int, order: int) -> np.ndarray:
    """Least-squares polynomial values at each of the window's points (Savitzky-Golay)."""
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def smooth_layers(source: str, out: str, n: int, c: Phenology) -> Layers:
    """The window's polynomial at each point; the first and last points use the first and last whole window."""
    window = min(c.window, n if n % 2 else n - 1)
    window = max(window, c.order + 2 + c.order % 2)
    window += 1 - window % 2
    if window > n:
        return [{out: "CAST(NULL AS DOUBLE)"}]
    m, half = smoothing_matrix(window, c.order), window // 2
    names = {d: source if not d else f"{out}_{'m' if d < 0 else 'p'}{abs(d)}" for d in range(-window + 1, window)}
    moves = {names[d]: f"{'lag' if d < 0 else 'lead'}({source}, {abs(d)}) OVER ({SERIES})" for d in names if d}
    row = lambda i, shift: " + ".join(f"({m[i, j]:.17g}) * {names[j - i]}" for j in range(window))
    ends = [f"WHEN k = {i} THEN {row(i, 0)}" for i in range(half)] + [f"WHEN k = {n - window + i} THEN {row(i, 0)}" for i in range(half + 1, window)]
    return [moves, {out: f"CASE {' '.join(ends)} ELSE {row(half, 0)} END"}]


def gradient_layers(source: str, out: str, n: int, days: float) -> Layers:
    """Central differences, one-sided at the ends, per day."""
    p, q = f"{out}_p", f"{out}_q"
    return [
        {p: f"lag({source}) OVER ({SERIES})", q: f"lead({source}) OVER ({SERIES})"},
        {out: f"CASE WHEN k = 0 THEN ({q} - {source}) / {days} WHEN k = {n - 1} THEN ({source} - {p}) / {days} ELSE ({q} - {p}) / ({2 * days}) END"},
    ]


def clean_layers(n: int, c: Phenology) -> Layers:
    """Despike, fill and smooth: columns f and s; pixels with too few observations are zero."""
    return [
        *observation_layers(), *fill_layers("v", "f0"), *despike_layers("v", "f0", "d", c), *fill_layers("d", "f1"),
        {"f": f"CASE WHEN n_obs >= {c.min_obs} THEN f1 ELSE 0.0 END"}, *smooth_layers("f", "s", n, c),
    ]


def smooth_series(series: DataFrame, n: int, c: Phenology | None = None) -> DataFrame:
    """pixel_id, k, t, v with the cleaned series f and the smoothed series s."""
    return apply(series, clean_layers(n, c or Phenology())).select("pixel_id", "k", "t", "v", "f", "s")
