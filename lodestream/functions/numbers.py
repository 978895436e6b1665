"""Scalar expressions: normal distribution, clipping, costs, sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def share_of(n: Column, share: float) -> Column:
    """The whole part of share * n for a count n, with share as it is written: 0.7 of 720 is 504, which doubles miss by a little."""
    return F.floor(n * F.lit(Decimal(str(share)))).cast("bigint")


def times_and_plus(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's and the sum's own errors are added back. Between values that are a few units of the last place
    apart (0.3 and 0.30000000000000004 as differences of prices), two roundings would pick the other one. For sizes below 1e290."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        return high, x - high

    product = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    back = total - product
    return total + (((product - (total - back)) + (c - back)) + lost)


#: Fixed coefficients of a published rational form of the normal tail (error below 1e-14), highest power first.
_TAIL_UP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DOWN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function: a rational form, beyond seven deviations a continued fraction."""
    a = F.abs(x)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    upper = F.exp(-a * a / 2) * F.when(a < 7, _poly(_TAIL_UP, a) / _poly(_TAIL_DOWN, a)).otherwise(1 / (far * math.sqrt(2 * math.pi)))
    return F.when(x >= 0, 1 - upper).otherwise(upper)


#: Fixed coefficients of the published rational approximation of the normal quantile (relative error below 1.15e-9).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(cs: Sequence[float], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function; NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _poly(_C, t) / (_poly(_D, t) * t + 1)
    return F.when((p <= 0) | (p >= 1), None).when((p >= 0.02425) & (p <= 0.97575), middle).when(p < 0.5, tail).otherwise(-tail)


def bet_size(p: Column, side: Column, classes: int = 2, step: float = 0.0) -> Column:
    """Size from a probability: 2 N(z) - 1 with z = (p - 1/k) / sqrt(p (1 - p)), in steps if wanted."""
    z = (p - 1 / classes) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)))
    size = side * (2 * norm_cdf(z) - 1)
    return clip(F.round(size / step) * step, -1, 1) if step else size


def trade_cost(fee: float, slippage_bps: float, legs: int = 1) -> float:
    """Round-trip cost as a share of notional."""
    return 2 * legs * (fee + slippage_bps / 1e4)


def impact(size: Column, volume: Column, sigma: Column, k: float) -> Column:
    """Square-root impact: k * sigma * sqrt(size / volume)."""
    return k * sigma * F.sqrt(F.greatest(size, F.lit(0.0)) / F.nullif(volume, F.lit(0.0)))


def shortfall_bps(side: Column, fill: Column, mid: Column) -> Column:
    """What a fill cost against the mid price, in basis points; positive is worse."""
    return F.when(side == "buy", fill - mid).otherwise(mid - fill) / mid * 1e4


def kelly(win: Column, ratio: Column, share: float = 0.5, most: float = 1.0) -> Column:
    """Part of the Kelly fraction win - (1 - win) / ratio, between 0 and most."""
    return clip(share * (win - (1 - win) / F.nullif(ratio, F.lit(0.0))), 0, most)


def session_hours(ts: Column, start: int, end: int) -> Column:
    """Whether the hour lies in [start, end), which may wrap around midnight."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def confident(side: Column, p: Column, least: float) -> Column:
    """The side where the probability is at least so large, else 0."""
    return F.when(p >= least, side).otherwise(0)


def age_text(then: Column, now: Column) -> Column:
    """Whole hours between two times as text, from two days on as days and hours."""
    h = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 3_600_000_000)
    return F.when(h >= 48, F.concat(F.floor(h / 24).cast("string"), F.lit("d "), (h % 24).cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h")))


def fingerprint(*names: str) -> Column:
    """Hash of the named columns as JSON, names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def money(x: Column, places: int) -> Column:
    """An amount as a decimal with fixed places."""
    return x.cast(f"decimal(18,{places})")


def taker_cost(fee: float, slippage_bps: float, volatility: Column) -> Column:
    """Fee and slippage a side; slippage grows with volatility above 1."""
    return F.lit(fee) + slippage_bps / 1e4 * F.greatest(F.lit(1.0), volatility)


def kelly_variance(mean: Column, variance: Column, share: float, most: float) -> Column:
    """Part of mean / variance, between 0 and most."""
    return F.least(F.lit(most), F.greatest(F.lit(0.0), share * (mean / F.nullif(variance, F.lit(0.0)))))


def scaled_size(base: Column, stress: Column, least: float) -> Column:
    """A size lowered by half of the stress (0 to 1), to a least share of it."""
    return base * F.greatest(F.lit(least), 1 - 0.5 * stress)


def excursions(price: Column, high: Column, low: Column, short: Column) -> tuple[Column, Column]:
    """Largest favourable and adverse move as shares of the entry price, 0 at least."""
    up, down = high / price - 1, 1 - low / price
    floor = lambda x: F.greatest(F.lit(0.0), x)
    return floor(F.when(short, down).otherwise(up)), floor(F.when(short, up).otherwise(down))


def hours_to_bars(hours: Column, bar_hours: float) -> Column:
    return F.ceil(hours / bar_hours)
