"""Exact combinatorics, as numbers on the driver and as columns."""

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def choose(n: Column, k: int) -> Column:
    """C(n, k) for a column n, as a product of ratios; 0 where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / F.lit(i + 1.0)
    return F.when(n >= k, out).otherwise(0.0)


def hypergeometric(pool: int, drawn: int, picked: int, m: int) -> float:
    """The chance that m of `picked` numbers are among `drawn` of `pool`."""
    if m < 0 or m > picked or drawn - m > pool - picked or m > drawn:
        return 0.0
    return comb(picked, m) * comb(pool - picked, drawn - m) / comb(pool, drawn)


def order_statistic(pool: int, size: int, r: int, v: int) -> float:
    """The chance that the r-th smallest of `size` numbers of `pool` is v."""
    if v < r or v > pool - (size - r):
        return 0.0
    return comb(v - 1, r - 1) * comb(pool - v, size - r) / comb(pool, size)


def position_interval(pool: int, size: int, r: int, low: int, high: int) -> float:
    """The chance that the r-th smallest of `size` numbers of `pool` lies in low..high."""
    return sum(order_statistic(pool, size, r, v) for v in range(max(1, low), min(pool, high) + 1))


def jackpot_odds(pool: int, size: int, bonus: int = 0) -> int:
    return comb(pool, size) * max(1, bonus)


def smoothed_rate(hits: Column, draws: Column, share: float, prior: float = 1.0) -> Column:
    """Hits a draw, with `prior` draws of the even share added."""
    return (hits + prior * share) / (draws + prior)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """The Wilson interval of a rate, as a struct of low and high; 0 to 1 without observations."""
    p = hits / F.greatest(n, F.lit(1))
    m = F.greatest(n, F.lit(1)).cast("double")
    centre, spread, scale = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    low, high = F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(1.0).alias("high"))


def edge_text(probability: Column, chance: float) -> Column:
    """How far a probability is from chance, in words: about chance within 3 %, else the rounded per cent above or below."""
    edge = probability / chance - 1 if chance > 0 else probability * 0.0
    return F.when(F.abs(edge) < 0.03, "about chance").otherwise(F.concat(F.when(edge > 0, "+").otherwise("-"), F.round(F.abs(edge) * 100).cast("int").cast("string"), F.lit("% vs chance")))
