"""Tests on quartet concordance counts, and the branch length of biallelic data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def star_test(n0: Column, n1: Column, n2: Column) -> Column:
    """p-value of three equal counts: a chi-square statistic with two degrees of freedom, whose tail is exp(-x / 2). -1 without counts."""
    total = (n0 + n1 + n2).cast("double")
    third = total / 3
    x = sum(((n - third) * (n - third) / third for n in (n1, n2)), (n0 - third) * (n0 - third) / third)
    return F.when(total > 0, F.exp(-x / 2)).otherwise(F.lit(-1.0))


#: Rows whose integrals are taken at once, and places at which an integrand is looked at.
ROWS, PLACES = 4096, 96


def tree_test_p(counts: np.ndarray) -> np.ndarray:
    """p-values of the tree model: the largest count's class is true and the other two are equally likely.

    A likelihood-ratio statistic is held against its null law (Mitchell, Allman and Rhodes 2019). The model is three line segments that meet in the star
    point. In units of the standard error at the fitted point, that point lies at distance mu from the star point on one of them, and the
    statistic is the squared distance of a normal point from the nearest line. Far from the star point it is chi-square with one degree of freedom; else what lies
    beyond a distance of all three lines are three wedges, over which the normal density is integrated.
    """
    c = np.sort(np.asarray(counts, float).reshape(-1, 3), axis=1)[:, ::-1]
    total = c.sum(1)
    out = np.ones(len(c))
    some = total > 0
    c, n = c[some], total[some]
    half = (c[:, 1] + c[:, 2]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda x: np.where(x > 0, x * np.log(x / half), 0.0)
        stat = np.maximum(2 * (term(c[:, 1]) + term(c[:, 2])), 0.0)
    phi = np.clip(3 * half / n, 1e-12, 1.0)
    mu = np.sqrt(2 * n) * (1 - phi) / np.sqrt(np.maximum(phi * (3 - 2 * phi), 1e-12))
    # The angle between the fitted line and each of the others, by the information at the fitted point; 120 degrees at the star point.
    angle = np.pi / 2 + np.arctan(1 / np.sqrt(3 * (3 - 2 * phi)))
    z = np.sqrt(stat)
    p = np.where(stat > 0, 2 * _normal_tail(z), 1.0)
    near = np.flatnonzero((stat > 0) & (mu <= 30) & (mu <= 8 * np.maximum(1.0, z)))
    for k in range(0, len(near), ROWS):
        at = near[k : k + ROWS]
        p[at] = _beyond(z[at], mu[at], angle[at])
    out[some] = np.clip(p, 0.0, 1.0)
    return out


def _normal_tail(x: np.ndarray) -> np.ndarray:
    """P(N > x), to seven digits of its own size: a rational Chebyshev fit of the complementary error function."""
    y = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + y / 2)
    # The coefficients of the fit.
    fit = np.polynomial.polynomial.polyval(t, [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277])
    half = t * np.exp(-y * y + fit) / 2
    return np.where(x >= 0, half, 1 - half)


def _beyond(z: np.ndarray, mu: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """P that N((mu, 0), I) is further than z from three rays from the origin: at 0 and at plus and minus an angle.

    Between two rays that is a wedge around their bisector, of the same opening, with its tip z / sin(half the opening) from the origin.
    """
    nodes, weights = np.polynomial.legendre.leggauss(PLACES)
    total = np.zeros(len(z))
    for turn, half in ((angle / 2, angle / 2), (-angle / 2, angle / 2), (np.full(len(z), np.pi), np.pi - angle)):
        tip, along, across = z / np.sin(half), mu * np.cos(turn), -mu * np.sin(turn)
        low = np.maximum(tip, along - 9)
        span = np.maximum(tip, along) + 9 - low
        # Most of the mass is near the tip where that is far out: places are denser there.
        u = ((nodes + 1) / 2) ** 2
        t = low[:, None] + span[:, None] * u
        width = (t - tip[:, None]) * np.tan(half)[:, None]
        inside = _normal_tail(-width - across[:, None]) - _normal_tail(width - across[:, None])
        total += (np.exp(-((t - along[:, None]) ** 2) / 2) * inside * span[:, None]) @ (weights * (nodes + 1) / 2) / math.sqrt(2 * math.pi)
    return total


@F.pandas_udf(DoubleType())
def tree_test(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """tree_test_p over columns."""
    return pd.Series(tree_test_p(np.column_stack([n0, n1, n2])))


def lambert_w(x: np.ndarray, steps: int = 40) -> np.ndarray:
    """The principal branch of w exp(w) = x for x >= -1/e, by Halley's iteration."""
    x = np.maximum(np.asarray(x, float), -1 / math.e)
    w = np.where(x > 1, np.log(np.maximum(x, 1e-300)), np.sqrt(np.maximum(0.0, 2 * (math.e * x + 1))) - 1)
    for _ in range(steps):
        e = np.exp(w)
        f = w * e - x
        down = e * (w + 1) - (w + 2) * f / np.where(np.abs(2 * w + 2) < 1e-12, 1e-12, 2 * w + 2)
        w = w - np.where(np.abs(down) < 1e-300, 0, f / np.where(down == 0, 1, down))
    return w


@F.pandas_udf(DoubleType())
def biallelic_length(q1: pd.Series) -> pd.Series:
    """Branch length from the main frequency of biallelic quartets: W(2/3 / (1 - q1) - 1); 0 up to a third, 9 for 1."""
    q = q1.to_numpy(float)
    inside = (q > 1 / 3) & (q < 1)
    length = lambert_w((2 / 3) / np.where(inside, 1 - q, 1) - 1)
    return pd.Series(np.where(q >= 1, 9.0, np.where(inside, length, 0.0)))
