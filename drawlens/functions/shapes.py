"""Features of a combination, as column expressions over its ascending array."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149]


def total(s: Column) -> Column:
    return F.aggregate(s, F.lit(0), lambda a, x: a + x)


def gaps_of(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(2), F.size(s)), lambda i: F.element_at(s, i) - F.element_at(s, i - 1))


def count_where(s: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(s, test))


def features(s: Column, k: int, d: int) -> dict[str, Column]:
    """Name and expression of the features that need no earlier draw: places, gaps, sums, and shape."""
    at = lambda i: F.element_at(s, i)
    gaps = gaps_of(s)
    mean = total(s) / F.lit(float(d))
    squares = F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    touching = F.transform(gaps, lambda g: (g == 1).cast("int"))
    third = k / 3
    zones = [count_where(s, lambda x: x <= third), count_where(s, lambda x: (x > third) & (x <= 2 * third)), count_where(s, lambda x: x > 2 * third)]
    out = {f"pos{r}": at(r) for r in range(1, d + 1)}
    out |= {f"gap{r}": at(r + 1) - at(r) for r in range(1, d)}
    out |= {"sum": total(s), "sumLow2": at(1) + at(2), "sumLow3": at(1) + at(2) + at(3), "sumHigh2": at(d) + at(d - 1)}
    out |= {"spread": at(d) - at(1), "sd": F.sqrt(squares / F.lit(float(d))), "maxGap": F.array_max(gaps), "minGap": F.array_min(gaps)}
    out |= {"consec": F.aggregate(touching, F.lit(0), lambda a, x: a + x)}
    out |= {"runs": F.aggregate(F.zip_with(touching, F.concat(F.array(F.lit(0)), touching), lambda x, p: F.when((x == 1) & (p == 0), 1).otherwise(0)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))}
    out |= {"odd": count_where(s, lambda x: x % 2 == 1), "prime": F.size(F.array_intersect(s, F.array(*[F.lit(p) for p in PRIMES])))}
    out |= {"lowZone": zones[0], "midZone": zones[1], "highZone": zones[2], "aboveMid": count_where(s, lambda x: x > (k + 1) / 2)}
    out |= {"emptyZones": sum(((z == 0).cast("int") for z in zones), F.lit(0)), "lastDigitDup": F.lit(d) - F.size(F.array_distinct(F.transform(s, lambda x: x % 10))), "centerDist": F.abs(mean - (k + 1) / 2)}
    return out


def bounds(k: int, d: int) -> dict[str, tuple[int, int]]:
    """The least and the most that each feature can be, as fixed values: they bound every band, and a histogram has bins() of them, known before any draw."""
    low, high = d * (d + 1) // 2, d * k - d * (d - 1) // 2
    out = {f"pos{r}": (r, k - d + r) for r in range(1, d + 1)} | {f"gap{r}": (1, k - d + 1) for r in range(1, d)}
    out |= {"sum": (low, high), "sumLow2": (3, 2 * k - 1), "sumLow3": (6, 3 * k - 3), "sumHigh2": (3, 2 * k - 1), "spread": (d - 1, k - 1), "sd": (0, k), "maxGap": (1, k - d + 1), "minGap": (1, (k - 1) // (d - 1))}
    out |= {"consec": (0, d - 1), "runs": (0, d // 2), "emptyZones": (0, 2), "lastDigitDup": (0, d - 1), "centerDist": (0, k)} | {n: (0, d) for n in ("odd", "prime", "lowZone", "midZone", "highZone", "aboveMid", "repeatPrev", "overlap3", "overlap10")}
    return out | {"dSum": (-high, high), "dSpread": (-k, k), "dOdd": (-d, d)}


def bins(k: int, d: int) -> dict[str, int]:
    """How many bins the histogram of each feature has: one for each whole value within its bounds, and one more above them, among which prior mass is shared."""
    return {name: hi - lo + 2 for name, (lo, hi) in bounds(k, d).items()}


def conditional(s: Column, prev: Column, last3: Column, last10: Column) -> dict[str, Column]:
    """Features against earlier draws; null where there is none."""
    has = prev.isNotNull()
    odd = lambda a: count_where(a, lambda x: x % 2 == 1)
    spread = lambda a: F.element_at(a, -1) - F.element_at(a, 1)
    own = {"repeatPrev": F.size(F.array_intersect(s, prev)), "overlap3": F.size(F.array_intersect(s, last3)), "overlap10": F.size(F.array_intersect(s, last10)), "dSum": total(s) - total(prev), "dSpread": spread(s) - spread(prev), "dOdd": odd(s) - odd(prev)}
    return {name: F.when(has, c) for name, c in own.items()}


# The play slip has columns of 14 numbers and five of them, the widths of grids in which a column counts, the widest of the tight steps,
# the least common factor, the span and the gap that make a family, and the numbers of some.
SLIP, SLIP_COLUMNS, GRIDS, TIGHT_STEP, LEAST_FACTOR, TIGHT_SPAN, WIDE_GAP = 14, 5, (9, 11, 12, 13), 11, 6, 7, 15
FIBONACCI, POWERS_OF_TWO = [1, 2, 3, 5, 8, 13, 21, 34, 55], [1, 2, 4, 8, 16, 32, 64, 128]


def families(s: Column, k: int, d: int) -> dict[str, Column]:
    """Named kinds of combination that are cut from a pool or watched, as tests of the ascending array. The tests name each place, without lambdas, so that they compile."""
    n = [F.element_at(s, i) for i in range(1, d + 1)]
    steps = [b - a for a, b in zip(n, n[1:], strict=False)]
    every = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    alike = lambda f: every(f(x) == f(n[0]) for x in n[1:])
    among = lambda values: every(x.isin([v for v in values if v <= k] or [0]) for x in n)
    div = lambda x, m: F.floor(x / m)
    even = every(g == steps[0] for g in steps[1:])
    digits = lambda x: [(x % 10, F.lit(True)), (div(x, 10) % 10, x >= 10), (div(x, 100), x >= 100)]
    seen = reduce(lambda a, b: a.bitwiseOR(b), [F.when(has, F.element_at(F.array(*[F.lit(1 << i) for i in range(10)]), v.cast("int") + 1)).otherwise(0) for x in n for v, has in digits(x)])
    row, column = (lambda x: (x - 1) % SLIP), (lambda x: div(x - 1, SLIP))
    return {
        "oneDecade": alike(lambda x: div(x - 1, 10)),
        "mult5": every(x % 5 == 0 for x in n),
        "sameDigit": alike(lambda x: x % 10),
        "evenSpaced": even,
        "evenStepTight": even & (steps[0] <= TIGHT_STEP),
        "tightSpan": n[-1] - n[0] <= TIGHT_SPAN,
        "runFive": every(g == 1 for g in steps),
        "slipRow": alike(row),
        "slipColumn": alike(lambda x: F.least(column(x), F.lit(SLIP_COLUMNS - 1))),
        "squareCube": among(sorted({i * i for i in range(1, 13)} | {i**3 for i in range(1, 6)})),
        "fib": among(FIBONACCI),
        "digitSum": alike(lambda x: div(x, 100) + div(x, 10) % 10 + x % 10),
        "column7": alike(lambda x: x % 7),
        "wideGaps": every(g >= WIDE_GAP for g in steps),
        "allPrime": among(PRIMES),
        "sameMultiple": some(every(x % m == 0 for x in n) for m in range(LEAST_FACTOR, k // d + 1)),
        "gridColumn": some(alike(lambda x, m=m: x % m) for m in GRIDS),
        "slipDiagonal": alike(lambda x: row(x) - column(x)) | alike(lambda x: row(x) + column(x)),
        "twoDigits": F.bit_count(seen) <= 2,
        "powerTwo": among(POWERS_OF_TWO),
        "repdigit": every((x >= 11) & ((x < 100) & (x % 11 == 0) | (x >= 100) & (x % 111 == 0)) for x in n),
        "mirrorPool": every(a + b == k + 1 for a, b in zip(n, n[::-1], strict=True)),
        "fibLike": every(c == a + b for a, b, c in zip(n, n[1:], n[2:], strict=False)),
        "triangular": among([i * (i + 1) // 2 for i in range(1, 17)]),
    }
