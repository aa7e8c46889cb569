"""Volume-delay functions and their derivatives, as Column builders.

flow v, capacity c, free-flow time t0, parameters alpha and beta; at v <= 0 the time is t0, and so, by convention of
the assignment's conjugate weights, is the derivative.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Callable[..., Column]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _guarded(v: Column, t0: Column, value: Column) -> Column:
    return F.when(v > 0, value).otherwise(t0)


def bpr(v, c, t0, alpha, beta) -> Column:
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    return _guarded(v, t0, t0 * (1 + a * F.pow(v / c, b)))


def bpr_derivative(v, c, t0, alpha, beta) -> Column:
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    return _guarded(v, t0, t0 * a * b * F.pow(v / c, b - 1) / c)


def bpr2(v, c, t0, alpha, beta) -> Column:
    """BPR with twice the exponent above capacity."""
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    return _guarded(v, t0, t0 * (1 + a * F.pow(v / c, F.when(v > c, 2 * b).otherwise(b))))


def bpr2_derivative(v, c, t0, alpha, beta) -> Column:
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    e = F.when(v > c, 2 * b).otherwise(b)
    return _guarded(v, t0, t0 * a * e * F.pow(v / c, e - 1) / c)


def conical(v, c, t0, alpha, beta) -> Column:
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    slack = a * (1 - v / c)
    return _guarded(v, t0, t0 * (F.sqrt(slack * slack + b * b) - slack - b + 2))


def conical_derivative(v, c, t0, alpha, beta) -> Column:
    v, c, t0, a, b = map(_col, (v, c, t0, alpha, beta))
    slack = a * (1 - v / c)
    return _guarded(v, t0, t0 * (a / c) * (1 - slack / F.sqrt(slack * slack + b * b)))


def inrets(v, c, t0, alpha, beta=1.0) -> Column:
    v, c, t0, a = map(_col, (v, c, t0, alpha))
    x = v / c
    return _guarded(v, t0, F.when(v <= c, t0 * (1.1 - a * x) / (1.1 - x)).otherwise(t0 * ((1.1 - a) / 0.1) * x * x))


def inrets_derivative(v, c, t0, alpha, beta=1.0) -> Column:
    v, c, t0, a = map(_col, (v, c, t0, alpha))
    x = v / c
    return _guarded(v, t0, F.when(v <= c, t0 * 1.1 * (1 - a) / ((1.1 - x) * (1.1 - x)) / c).otherwise(t0 * ((1.1 - a) / 0.1) * 2 * x / c))


FUNCTIONS: dict[str, tuple[Expr, Expr]] = {
    "bpr": (bpr, bpr_derivative),
    "bpr2": (bpr2, bpr2_derivative),
    "conical": (conical, conical_derivative),
    "inrets": (inrets, inrets_derivative),
}


def vdf(name: str) -> tuple[Expr, Expr]:
    """(time, derivative) builders of a function by name."""
    if name.lower() not in FUNCTIONS:
        raise ValueError(f"unknown volume-delay function {name!r}; there are {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name.lower()]


def check_parameters(alpha: np.ndarray, beta: np.ndarray) -> None:
    """Parameters are numbers, alpha not negative and beta one or more."""
    if np.isnan(alpha).any() or np.isnan(beta).any():
        raise ValueError("a volume-delay parameter is missing")
    if (alpha < 0).any() or (beta < 1).any():
        raise ValueError("alpha must be at least 0 and beta at least 1")


def array_vdf(name: str):
    """(time, derivative) over numpy arrays, for line searches over link vectors that the driver already holds."""
    vdf(name)

    def parts(v, c, a, b):
        x = np.maximum(v, 0) / c
        with np.errstate(divide="ignore", invalid="ignore"):
            if name == "conical":
                s = a * (1 - x)
                r = np.sqrt(s * s + b * b)
                return r - s - b + 2, (a / c) * (1 - s / r)
            if name == "inrets":
                return np.where(x <= 1, (1.1 - a * x) / (1.1 - x), (1.1 - a) / 0.1 * x * x), np.where(x <= 1, 1.1 * (1 - a) / (1.1 - x) ** 2, (1.1 - a) / 0.1 * 2 * x) / c
            e = np.where(x > 1, 2 * b, b) if name == "bpr2" else b
            return 1 + a * x**e, a * e * x ** (e - 1) / c

    def time(v, c, t0, a, b):
        return np.where(v > 0, t0 * parts(v, c, a, b)[0], t0)

    def slope(v, c, t0, a, b):
        return np.where(v > 0, t0 * parts(v, c, a, b)[1], t0)

    return time, slope
