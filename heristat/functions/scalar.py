"""Scalar formulas on results."""

from __future__ import annotations

import math
from statistics import NormalDist


def liability(h2: float, se: float, samp_prev: float, pop_prev: float) -> tuple[float, float, float]:
    """Heritability on the liability scale, its standard error, and the p-value of h2 by a chi-square with one degree."""
    height = NormalDist().pdf(NormalDist().inv_cdf(pop_prev))
    factor = (pop_prev * (1 - pop_prev) / height) ** 2 / (samp_prev * (1 - samp_prev))
    p = math.erfc(abs(h2 / se) / math.sqrt(2)) if se else float("nan")
    return h2 * factor, se * factor, p
