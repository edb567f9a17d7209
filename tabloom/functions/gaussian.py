"""Normal distribution function and its inverse on NumPy arrays."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Abramowitz and Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# P. J. Acklam's rational approximation of the inverse normal distribution function.
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
INV_LOW = 0.02425

CLAMP = 1e-6

# Task-side functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cdf(z: np.ndarray) -> np.ndarray:
    """P(Z <= z) for a standard normal Z."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    upper = 0.5 * np.polyval(tuple(reversed(ERF_A)), t) * t * np.exp(-x * x)
    return np.where(z >= 0, 1.0 - upper, upper)


def inverse_cdf(u: np.ndarray) -> np.ndarray:
    """The z with P(Z <= z) = u; u is clamped to [1e-6, 1 - 1e-6] and NaN stays NaN."""
    p = np.clip(u, CLAMP, 1 - CLAMP)
    q = p - 0.5
    z = np.polyval(INV_A, q * q) * q / np.polyval(INV_B + (1.0,), q * q)
    outer = np.minimum(p, 1 - p) < INV_LOW
    t = np.sqrt(-2.0 * np.log(np.minimum(p, 1 - p)[outer]))
    z[outer] = -np.sign(q[outer]) * np.polyval(INV_C, t) / np.polyval(INV_D + (1.0,), t)
    return z
