"""Probabilities of unit-root statistics, from a published response surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.numbers import norm_cdf

#: Fixed values of the published approximation with a constant, for 1 to 6 series: bounds of the statistic, where the first polynomial ends, and
#: both polynomials' coefficients, lowest power first.
LEAST = (-18.83, -18.86, -23.48, -28.07, -25.96, -23.27)
MOST = (2.74, 0.92, 0.55, 0.61, 0.79, 1.0)
SPLIT = (-1.61, -2.62, -3.13, -3.47, -3.78, -3.93)
SMALL = ((2.1659, 1.4412, 0.038269), (2.92, 1.5012, 0.039796), (3.4699, 1.4856, 0.03164), (3.9673, 1.4777, 0.026315), (4.5509, 1.5338, 0.029545), (5.1399, 1.6036, 0.034445))
LARGE = (
    (1.7339, 0.93202, -0.12745, -0.010368), (2.1945, 0.64695, -0.29198, -0.042377), (2.5893, 0.45168, -0.36529, -0.050074),
    (3.0387, 0.45452, -0.33666, -0.041921), (3.5049, 0.52098, -0.29158, -0.033468), (3.9489, 0.58933, -0.25359, -0.02721),
)


def _powers(cs: Sequence[float], t: Column) -> Column:
    out = F.lit(cs[-1])
    for c in reversed(cs[:-1]):
        out = out * t + c
    return out


def root_probability(t: Column, series: int = 1) -> Column:
    """Probability of a statistic as low as t under a unit root: of one series, or of the residuals of one of `series` series on the others."""
    k = series - 1
    inside = norm_cdf(F.when(t <= SPLIT[k], _powers(SMALL[k], t)).otherwise(_powers(LARGE[k], t)))
    return F.when(t < LEAST[k], 0.0).when(t > MOST[k], 1.0).when(t.isNotNull(), inside)
