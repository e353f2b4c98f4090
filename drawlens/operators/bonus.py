"""The bonus number: its signals, their walk-forward evaluation, and the live choice."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.history import BLOCK, History, gapless
from drawlens.operators import learn, signals

KEYS = ["sFreq", "sRecency", "sDow", "sOverdue", "sFollower"]
HALF_LIFE, TOP, PICKS, RANK_PRIOR = 25, 3, 4, 25.0  # fixed values
FREQUENCY, WEEKDAY, FOLLOWER = 10, 12, 8  # fixed values: draws of the even share, or of the number's own rate, that are added


def indexed(h: History) -> DataFrame:
    """game, s, t, dow, special, prev: the draws with a bonus number in the pool, s their place from 0 and prev the bonus number before. Places are counts of blocks of draws, then within a block, so no game is sorted in one task."""
    rows = gapless(h.draws.where(F.col("special").between(1, h.ks)).select("game", "t", "dow", "special"), "s").select("game", "s", "t", "dow", "special")
    return rows.join(rows.select("game", (F.col("s") + 1).alias("s"), F.col("special").alias("prev")), ["game", "s"], "left")


def running(rows: DataFrame, parts: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """rows (game, s; a written table, as it is read once for each part) with a column for each of parts: the sum of a value over the rows before, in the group of some columns: sums of earlier blocks of s, and those of the own block until then."""
    base = rows.withColumn("_b", F.floor(F.col("s") / BLOCK))
    out = base
    for name, (by, value) in parts.items():
        own = Window.partitionBy("game", *by, "_b").orderBy("s").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    for name, (by, value) in parts.items():
        blocks = base.groupBy("game", *by, "_b").agg(F.sum(value).alias("_s"))
        earlier = blocks.select("game", *by, "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("game", *by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_e"))
        out = out.join(earlier, ["game", *by, "_b"]).withColumn(name, F.col(name) + F.col("_e")).drop("_e")
    return out.drop("_b")


def asked(h: History) -> tuple[DataFrame, DataFrame]:
    """indexed(), and the same with the draw to come (special null) and p, the bonus number before or 0. Both are written tables."""
    drawn = cut(indexed(h))
    ahead = signals.next_draw(h).select("game", "t", "dow")
    last = drawn.groupBy("game").agg((F.max("s") + 1).alias("s"), F.max_by("special", "s").alias("prev"))
    rows = drawn.unionByName(ahead.join(last, "game").select("game", "s", "t", "dow", F.lit(None).cast("int").alias("special"), "prev"))
    return drawn, cut(rows.withColumn("p", F.coalesce("prev", F.lit(0))))


def raw(h: History) -> DataFrame:
    """game, s, t, n, hit, count, since and KEYS, for every number of the pool before each draw with a bonus number, and, with hit null, before the draw to come."""
    drawn, rows = asked(h)
    has = F.col("special").isNotNull()
    counted = running(rows, {"n_dow": (["dow"], has.cast("long")), "n_prev": (["p"], (has & F.col("prev").isNotNull()).cast("long"))})
    grid = counted.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(h.ks)))).withColumn("hit", (F.col("special") == F.col("n")).cast("int"))
    grid = cut(grid.withColumn("at", F.when(F.col("hit") == 1, F.col("s"))).withColumn("b", F.floor(F.col("s") / BLOCK)))
    one = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    # The draw that has it last: the latest of earlier blocks, or of the own block until then; gaps add up to last less first.
    blocks = grid.groupBy("game", "n", "b").agg(F.max("at").alias("m"))
    earlier = blocks.select("game", "n", "b", F.max("m").over(Window.partitionBy("game", "n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("seen0"))
    first = drawn.groupBy("game", F.col("special").alias("n")).agg(F.min("s").alias("first"))
    out = running(grid, {"count": (["n"], one), "c_dow": (["n", "dow"], one), "c_prev": (["n", "p"], one * (F.col("p") > 0).cast("long"))})
    out = out.withColumn("seen1", F.max("at").over(Window.partitionBy("game", "n", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)))
    out = out.join(earlier, ["game", "n", "b"]).join(first, ["game", "n"], "left").withColumn("seen", F.coalesce("seen1", "seen0"))
    since = F.coalesce(F.col("s") - F.col("seen"), F.col("s"))
    gap = F.when(F.col("count") >= 2, (F.col("seen") - F.col("first")) / (F.col("count") - 1)).otherwise(float(h.ks))
    base = (F.col("count") + FREQUENCY / h.ks) / (F.col("s") + FREQUENCY)
    held = History(drawn.select("game", F.col("s").alias("t"), "dow", F.array("special").alias("sorted")), h.ks, 1, 0)
    recent = signals.recency(held, HALF_LIFE, rows.select("game", F.col("s").alias("t")), "sRecency").withColumnRenamed("t", "s")
    return out.join(recent, ["game", "s", "n"]).select(
        "game", "s", "t", "n", "hit", "count", since.alias("since"), base.alias("sFreq"), "sRecency", ((F.col("c_dow") + WEEKDAY * base) / (F.col("n_dow") + WEEKDAY)).alias("sDow"), F.least(F.lit(3.0), since / F.greatest(F.lit(1.0), gap)).alias("sOverdue"),
        F.when(F.col("p") > 0, (F.col("c_prev") + FOLLOWER * base) / (F.col("n_prev") + FOLLOWER)).otherwise(base).alias("sFollower"),
    )


def live(h: History) -> DataFrame:
    """game, n and KEYS: the signals for the draw to come."""
    return raw(h).where("hit is null").select("game", "n", *KEYS)


def _earlier(hit: np.ndarray, of: np.ndarray, kinds: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how often each number came in the rows before it that are of its kind (of: 0..kinds - 1), and those counts after the last row, by kind. start: the counts before the first row, by kind."""
    out, end = np.zeros(hit.shape), start.copy()
    for kind in range(kinds):
        at = np.flatnonzero(of == kind)
        if len(at):
            run = np.cumsum(hit[at], axis=0)
            out[at] = start[kind] + run - hit[at]
            end[kind] = start[kind] + run[-1]
    return out, end


class Counts:
    """What the draws before a block leave for its signals: counts by number, by weekday and by the number before, the first and the last place of each number, and the moving share."""

    def __init__(self, ks: int) -> None:
        self.ks, self.by_day, self.by_prev, self.days, self.prevs = ks, np.zeros((7, ks)), np.zeros((ks + 1, ks)), np.zeros((7, 1)), np.zeros((ks + 1, 1))
        self.first, self.seen, self.moving = np.full(ks, np.inf), np.full(ks, -1.0), np.zeros(ks)

    def fields(self) -> list[np.ndarray]:
        return [self.by_day, self.by_prev, self.days, self.prevs, self.first, self.seen, self.moving]

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.fields()]).tobytes()

    @classmethod
    def of(cls, packed: bytes, ks: int) -> "Counts":
        out, flat, at = cls(ks), np.frombuffer(packed), 0
        for x in out.fields():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    def then(self, more: "Counts", draws: int) -> None:
        """The counts after a block of so many draws that leaves `more` of its own."""
        for mine, its in zip(self.fields()[:4], more.fields()[:4], strict=True):
            mine += its
        self.first, self.seen = np.minimum(self.first, more.first), np.maximum(self.seen, more.seen)
        self.moving = self.moving * 0.5 ** (draws / HALF_LIFE) + more.moving

    def signals(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(KEYS by number, hits by number, count, since) before each row (s, dow, special, p), in order of s; leaves the counts after them. raw() says the same by tables."""
        ks, w = self.ks, 0.5 ** (1 / HALF_LIFE)
        s, dow, p = (rows[c].to_numpy(np.int64) for c in ("s", "dow", "p"))
        hit = (rows["special"].fillna(0).to_numpy(np.int64)[:, None] == np.arange(1, ks + 1)).astype(float)
        has = hit.sum(axis=1, keepdims=True)
        total, met = self.by_day.sum(axis=0), (p > 0)[:, None]
        count = total + np.cumsum(hit, axis=0) - hit
        by_day, self.by_day = _earlier(hit, dow, 7, self.by_day)
        by_prev, self.by_prev = _earlier(hit * met, p, ks + 1, self.by_prev)
        days, self.days = _earlier(has, dow, 7, self.days)
        prevs, self.prevs = _earlier(has * met, p, ks + 1, self.prevs)
        at = np.where(hit > 0, s[:, None], -1.0)
        upto = np.maximum(np.maximum.accumulate(at, axis=0), self.seen)
        seen = np.vstack([self.seen, upto[:-1]])
        self.seen = upto[-1]
        some = hit.any(axis=0)
        self.first = np.minimum(self.first, np.where(some, s[hit.argmax(axis=0)], np.inf))
        i = np.arange(len(s))[:, None]
        sums = np.cumsum(hit * w ** -i.astype(float), axis=0) - hit * w ** -i.astype(float)
        moving = self.moving * w**i + (1 - w) * w ** (i - 1.0) * sums
        self.moving = (moving[-1] * w + (1 - w) * hit[-1]) if has[-1] else moving[-1]
        since = np.where(seen >= 0, s[:, None] - seen, s[:, None])
        gap = np.where(count >= 2, (seen - np.where(np.isinf(self.first), 0, self.first)) / np.maximum(count - 1, 1), float(ks))
        base = (count + FREQUENCY / ks) / (s[:, None] + FREQUENCY)
        keys = [base, moving, (by_day + WEEKDAY * base) / (days + WEEKDAY), np.minimum(3.0, since / np.maximum(1.0, gap)), np.where(met, (by_prev + FOLLOWER * base) / (prevs + FOLLOWER), base)]
        return np.stack(keys, axis=2), hit, count, since


def backtest(h: History) -> dict[str, DataFrame]:
    """The bonus number's own walk-forward evaluation, over the draws that have one, from the 31st draw on: signals (by key), ranks, points (game, t, top1, top3, picks), summary, and picks, the four best for the draw to come with their calibrated chances.

    A signal hits if the number is among its three best; weights, blending and calibration are those of learn.backtest(), with 25 draws of chance added to each rank.
    Three passes over blocks of draws, each of which a task takes alone: what a block leaves for the signals of later ones; the hits of its signals; scores and ranks. Between passes, what blocks leave is added up, a row for each block. Signals are worked out where they are needed and never written.
    """
    ks, chance = h.ks, min(TOP, h.ks) / h.ks
    _, rows = asked(h)
    rows = rows.withColumn("b", F.floor(F.col("s") / BLOCK)).select("game", "b", "s", "t", "dow", "special", "p")

    def left(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, own = rows.sort_values("s"), Counts(ks)
        own.signals(rows)
        return pd.DataFrame([(*key, int(rows["special"].notna().sum()), own.packed())], columns=["game", "b", "draws", "counts"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        run, out = Counts(ks), []
        for r in rows.sort_values("b").itertuples():
            out.append((r.game, r.b, run.packed()))
            run.then(Counts.of(r.counts, ks), r.draws)
        return pd.DataFrame(out, columns=["game", "b", "counts"])

    starts = cut(rows.groupBy("game", "b").applyInPandas(left, "game string, b long, draws long, counts binary").groupBy("game").applyInPandas(added, "game string, b long, counts binary"))

    def scored(rows: pd.DataFrame, counts: bytes) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows that are judged (drawn, or to come), with z, hits, the hits of each signal, counts and draws since."""
        rows = rows.sort_values("s")
        x, hit, count, since = Counts.of(counts, ks).signals(rows)
        use = (rows["special"].isna() | (rows["t"] >= learn.LEAST_HISTORY)).to_numpy()
        rows, x, hit, count, since = rows[use], x[use], hit[use], count[use], since[use]
        z = learn.deviations(x)
        return rows, z, hit, learn.hits_of(z, hit, TOP), count, since

    def tried(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows, _, _, hits, _, _ = scored(rows, start["counts"].iloc[0])
        return pd.DataFrame([(*key, learn.left_of(hits[rows["special"].notna().to_numpy()], chance))], columns=["game", "b", "hits"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        return rows.assign(skill=learn.skill_states(rows["hits"], len(KEYS)))[["game", "b", "skill"]]

    blocks = rows.groupBy("game", "b")
    tallies = cut(blocks.cogroup(starts.groupBy("game", "b")).applyInPandas(tried, "game string, b long, hits binary"))
    starts = cut(starts.join(tallies.groupBy("game").applyInPandas(summed, "game string, b long, skill binary"), ["game", "b"]))

    def judged(key, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows, z, hit, hits, count, since = scored(rows, start["counts"].iloc[0])
        weight, done = learn.weights_of(hits, start["skill"].iloc[0], chance)
        order = np.argsort(-np.round((z * weight[:, None, :]).sum(axis=2), 12), axis=1, kind="stable")
        place = np.take_along_axis(hit, order, axis=1).argmax(axis=1) + 1
        out = pd.DataFrame({"game": key[0], "t": rows["t"].to_numpy(), "place": pd.array(place, dtype="Int32"), "picks": pd.Series(list(order[:, :TOP].astype(np.int32) + 1), dtype=object), "weight": None, "best": None, "count": None, "since": None})
        ahead = rows["special"].isna().to_numpy()
        out.loc[ahead, "place"] = pd.NA
        for i in np.flatnonzero(ahead):
            for name, value in {"weight": weight[i], "best": order[i, :PICKS].astype(np.int32) + 1, "count": count[i][order[i, :PICKS]].astype(np.int64), "since": since[i][order[i, :PICKS]].astype(np.int64)}.items():
                out.at[out.index[i], name] = value
        return out[~ahead | (done > 0)]

    schema = "game string, t long, place int, picks array<int>, weight array<double>, best array<int>, count array<long>, since array<long>"
    out = cut(blocks.cogroup(starts.groupBy("game", "b")).applyInPandas(judged, schema))
    seen, ahead = out.where("place is not null"), out.where("place is null")
    points = seen.select("game", "t", (F.col("place") == 1).cast("long").alias("top1"), (F.col("place") <= TOP).cast("long").alias("top3"), "picks")
    summary = points.groupBy("game").agg(F.count(F.lit(1)).alias("evaluated"), F.avg("top1").alias("top1"), F.avg("top3").alias("top3"), F.lit(1 / ks).alias("chance1"), F.lit(chance).alias("chance3"))
    ranks = learn.calibrated_counts(seen.groupBy("game", F.col("place").alias("rank")).agg(F.count(F.lit(1)).alias("hits")), seen.groupBy("game").agg(F.count(F.lit(1)).alias("evaluated")), ks, 1 / ks, RANK_PRIOR)
    picks = ahead.select("game", F.posexplode(F.arrays_zip("best", "count", "since")).alias("i", "x")).select("game", (F.col("i") + 1).alias("place"), F.col("x.best").alias("n"), F.col("x.count").alias("count"), F.col("x.since").alias("since"))
    picks = picks.join(ranks.select("game", F.col("rank").alias("place"), F.col("fit").alias("probability")), ["game", "place"], "left").select("game", "place", "n", F.coalesce("probability", F.lit(1 / ks)).alias("probability"), "count", "since")
    return {"signals": learn.performance_of(tallies, ahead, KEYS, chance), "ranks": ranks, "points": points, "summary": summary, "picks": picks}
