"""The bands that features keep to as of each draw: order statistics that run along a history, by blocks of draws."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.functions.shapes import bins, bounds

UNIT = 10_000  # tails are whole parts of this many, so that no tie hangs on a rounding
BLOCK = 4096  # draws to a block; a draw looks at what its own block had before it and at the histogram of all earlier blocks
CONDITIONAL = ["repeatPrev", "overlap3", "overlap10", "dSum", "dSpread", "dOdd"]  # features that the first draw doesn't have


def _facts(values: DataFrame, k: int, d: int) -> DataFrame:
    """values (game, feature, t, v) with n, the earlier draws that have the feature, base and top, its bounds, and room, its bins."""
    limits, rooms = bounds(k, d), bins(k, d)
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("feature"))
    rows = values.withColumn("n", F.col("t") - F.when(F.col("feature").isin(CONDITIONAL), 1).otherwise(0))
    return rows.withColumn("base", of({f: lo for f, (lo, _) in limits.items()})).withColumn("top", of({f: hi for f, (_, hi) in limits.items()})).withColumn("room", of(rooms))


def _bin(v: Column) -> Column:
    """The bin of a value, from 0."""
    return (F.floor(v + 0.5) - F.col("base")).cast("int")


def _within(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Two ends of a band, in order, within the feature's bounds."""
    return F.greatest(F.least(lo, hi), F.col("base")), F.least(F.greatest(lo, hi), F.col("top"))


def whole(values: DataFrame, k: int, d: int, tails: dict[str, int]) -> DataFrame:
    """game, feature, n, least, most, and <name>_lo and <name>_hi for each tail (parts of UNIT): the bands from all draws. least and most are the values that occurred.

    One draw more is shared evenly among a feature's bins. The low end is the first bin at which the mass up to it exceeds the tail, the high end the first at which the mass above it doesn't.
    """
    rows = _facts(values, k, d).select("game", "feature", "base", "top", "room", _bin(F.col("v")).alias("x"))
    counts = rows.groupBy("game", "feature", "base", "top", "room", "x").agg(F.count(F.lit(1)).alias("c"))
    cells = counts.groupBy("game", "feature", "base", "top", "room").agg(F.sum("c").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("room") - 1)).alias("x")).join(counts.select("game", "feature", "x", "c"), ["game", "feature", "x"], "left")
    cells = cells.withColumn("upto", F.coalesce(F.sum("c").over(Window.partitionBy("game", "feature").orderBy("x")), F.lit(0)))
    mass, grand = UNIT * (F.col("upto") * F.col("room") + F.col("x") + 1), (F.col("n") + 1) * F.col("room")
    ends = []
    for name, a in tails.items():
        ends += [F.min(F.when(mass > a * grand, F.col("x"))).alias(f"{name}_a"), F.min(F.when(mass >= (UNIT - a) * grand, F.col("x"))).alias(f"{name}_b")]
    out = cells.groupBy("game", "feature", "n", "base", "top", "first", "last").agg(*ends)
    cols = []
    for name in tails:
        lo, hi = _within(F.col("base") + F.col(f"{name}_a"), F.col("base") + F.col(f"{name}_b"))
        cols += [lo.cast("int").alias(f"{name}_lo"), hi.cast("int").alias(f"{name}_hi")]
    return out.select("game", "feature", "n", (F.col("base") + F.col("first")).alias("least"), (F.col("base") + F.col("last")).alias("most"), *cols)


def _ends(x: np.ndarray, n: np.ndarray, pre: np.ndarray, tails: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tail the bins (lo, hi) of the band before each draw of a block, as whole() defines it. x: bins of the draws (-1: none), n: how many came before each, pre: the histogram before the block."""
    room = len(pre)
    drawn = x >= 0
    start, end = np.cumsum(pre), np.cumsum(pre + np.bincount(x[drawn], minlength=room))
    mass = lambda c, at: UNIT * (c * room + at + 1)
    bins_ = np.arange(room)

    def first(goal: np.ndarray, side: str) -> np.ndarray:
        """The first bin whose mass exceeds (side right) or reaches (left) each draw's goal. Masses grow along the bins and along the block, so only the bins between two bounds are counted draw by draw."""
        a, b = np.searchsorted(mass(end, bins_), goal[0], side), np.searchsorted(mass(start, bins_), goal[-1], side)
        if a == b:
            return np.full(len(x), a)
        some = bins_[a:b]
        below = (x[:, None] <= some) & drawn[:, None]
        m = mass(start[a:b] + np.cumsum(below, axis=0) - below, some)
        return b - ((m > goal[:, None]) if side == "right" else (m >= goal[:, None])).sum(axis=1)

    grand = (n + 1) * room
    return [(first(a * grand, "right"), first((UNIT - a) * grand, "left")) for a in tails]


def chunks(rows: DataFrame, k: int, d: int, tails: list[int], size: int = BLOCK, least: int = 0) -> DataFrame:
    """game, feature, block, t0, dow, v, by, and lo<i>, hi<i> for each tail (parts of UNIT, below half): a row for each feature and block of draws, with arrays of a value for each draw from t0 on: the feature, and its band before the draw, as whole() defines it; the draw to come has no value (null) and the weekday -1. Draws before `least` are left out.

    rows: game, t (gapless), dow and a column for each feature; `by` (null for most features) is what a feature against earlier draws starts from: the value before it, or how many numbers those draws had (columns _<feature>, if rows have them).
    A first pass counts each block's values; the histograms before each block are running sums of those, a row for each block; with them a task takes one block alone. Bands move little within a block, so few bins are counted draw by draw.
    """
    limits, rooms = bounds(k, d), bins(k, d)
    names = [c for c in rows.columns if c in limits]
    extra = {c: f"_{c}" for c in CONDITIONAL if f"_{c}" in rows.columns}
    edges = np.cumsum([0, *[rooms[f] for f in names]])

    def bin_of(f: str, v: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(v), -1, np.floor(v + 0.5) - limits[f][0]).astype(np.int64)

    def counted(parts):
        for rows in parts:
            out = []
            for (game, block), some in rows.groupby(["game", "block"]):
                found = [bin_of(f, some[f].to_numpy(float)) for f in names]
                out.append((game, block, np.concatenate([np.bincount(x[x >= 0], minlength=rooms[f]) for f, x in zip(names, found, strict=True)]).astype(np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["game", "block", "c"])

    def before(rows: pd.DataFrame) -> pd.DataFrame:
        game, last = rows["game"].iloc[0], int(rows["block"].max()) + 1
        of: dict = {}
        for b, c in zip(rows["block"], rows["c"], strict=True):
            of[b] = of.get(b, 0) + np.frombuffer(c, np.int64)
        run, out = np.zeros(edges[-1], np.int64), []
        for b in range(last + 1):
            out.append((game, b, run.tobytes()))
            run = run + of.get(b, 0)
        return pd.DataFrame(out, columns=["game", "block", "pre"])

    def judged(key, rows: pd.DataFrame, pre: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("t")
        for i, f in enumerate(names if len(rows) else []):
            base, top = limits[f]
            v, t = rows[f].to_numpy(float), rows["t"].to_numpy(np.int64)
            known = ~np.isnan(v) | rows["ahead"].to_numpy(bool)
            t, v = t[known], v[known]
            if not len(t) or t[-1] < least:
                continue
            n = t - (f in CONDITIONAL)
            ends = _ends(bin_of(f, v), n, np.frombuffer(pre["pre"].iloc[0], np.int64)[edges[i] : edges[i + 1]], tails)
            keep = t >= least
            cells = {"game": key[0], "feature": f, "block": key[1], "t0": t[keep][0], "dow": rows["dow"].fillna(-1).to_numpy()[known][keep].astype(np.int8), "v": v[keep], "by": rows[extra[f]].fillna(0).to_numpy()[known][keep].astype(np.int16) if f in extra else None}
            for j, (lo, hi) in enumerate(ends):
                lo, hi = base + np.minimum(lo, hi), base + np.maximum(lo, hi)
                cells[f"lo{j}"] = np.where(n == 0, base, np.maximum(lo, base))[keep].astype(np.int16)
                cells[f"hi{j}"] = np.where(n == 0, top, np.minimum(hi, top))[keep].astype(np.int16)
            out.append(cells)
        return pd.DataFrame(out, columns=columns)

    ends_ = [f"{s}{j}" for j in range(len(tails)) for s in ("lo", "hi")]
    columns = ["game", "feature", "block", "t0", "dow", "v", "by", *ends_]
    schema = "game string, feature string, block long, t0 long, dow array<tinyint>, v array<double>, by array<smallint>, " + ", ".join(f"{c} array<smallint>" for c in ends_)
    rows = rows.select("game", "t", "dow", *[F.col(c).cast("double").alias(c) for c in names], *extra.values(), F.floor(F.col("t") / size).alias("block"), F.lit(False).alias("ahead"))
    ahead = rows.groupBy("game").agg((F.max("t") + 1).alias("t")).withColumn("block", F.floor(F.col("t") / size)).withColumn("ahead", F.lit(True))
    pre = rows.drop(*extra.values()).mapInPandas(counted, "game string, block long, c binary").groupBy("game").applyInPandas(before, "game string, block long, pre binary")
    rows = rows.unionByName(ahead, allowMissingColumns=True)
    return rows.groupBy("game", "block").cogroup(pre.groupBy("game", "block")).applyInPandas(judged, schema)


def draws_of(chunk: DataFrame, *more: str, tails: int = 0) -> DataFrame:
    """chunks() with a row for each draw: game, feature, t, dow, v, by, the columns of `more`, and `bands`, an array of lo and hi for each of `tails`."""
    ends = [f"{s}{j}" for j in range(tails) for s in ("lo", "hi")]
    cells = F.arrays_zip("dow", "v", F.coalesce("by", F.array().cast("array<smallint>")).alias("by"), *[c for c in ("lo", "hi") if c in chunk.columns], *ends)
    rows = chunk.select("game", "feature", *more, "t0", F.posexplode(cells).alias("i", "x"))
    bands = [F.array(*[F.struct(F.col(f"x.lo{j}").cast("int").alias("lo"), F.col(f"x.hi{j}").cast("int").alias("hi")) for j in range(tails)]).alias("bands")] if tails else []
    single = [F.col(f"x.{c}").cast("int").alias(c) for c in ("lo", "hi") if c in chunk.columns]
    return rows.select("game", "feature", *more, (F.col("t0") + F.col("i")).alias("t"), F.when(F.col("x.dow") >= 0, F.col("x.dow")).cast("int").alias("dow"), F.col("x.v").alias("v"), F.col("x.by").cast("int").alias("by"), *single, *bands)


def asof(values: DataFrame, k: int, d: int, tails: list[int], size: int = BLOCK) -> DataFrame:
    """game, feature, t, dow, v, and bands, an array of (lo, hi) for each tail: chunks() of long values (game, t, dow, feature, v; a feature's t are gapless), a row for each draw, and, with v null, for the draw to come."""
    wide = values.groupBy("game", "t", "dow").pivot("feature", list(bounds(k, d))).agg(F.first("v"))
    return draws_of(chunks(wide, k, d, tails, size), tails=len(tails)).drop("by")


def held(v: Column, lo: Column, hi: Column) -> Column:
    """Whether a value, as it is, lies within a band."""
    return (v >= lo) & (v <= hi)
