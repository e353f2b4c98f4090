"""A game's counters, kept from draw to draw by a stateful stream."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drawlens.operators.learn import learned

OUT = "game string, n int, hits long, last_seen long, draws long"


class Counters(StatefulProcessor):
    """For each game: draws so far, and for each number its hits and last place. Each draw costs its own numbers, whatever the history's length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draws = handle.getValueState("draws", "draws long")
        self.numbers = handle.getMapState("numbers", "n int", "hits long, last_seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        t = self.draws.get()[0] if self.draws.exists() else 0
        touched = {}
        for part in rows:
            for numbers in part.sort_values("date")["sorted"]:
                for n in numbers:
                    n = int(n)
                    had = touched.get(n) or (self.numbers.getValue((n,)) if self.numbers.containsKey((n,)) else (0, -1))
                    touched[n] = (had[0] + 1, t)
                t += 1
        for n, value in touched.items():
            self.numbers.updateValue((n,), value)
        self.draws.update((t,))
        yield pd.DataFrame([(key[0], n, hits, last, t) for n, (hits, last) in sorted(touched.items())], columns=["game", "n", "hits", "last_seen", "draws"])

    def close(self) -> None:
        pass


def counted(draws: DataFrame) -> DataFrame:
    """The counters that each micro-batch of draws changes: game, n, hits, last_seen, draws."""
    return draws.groupBy("game").transformWithStateInPandas(Counters(), OUT, "Update", "None")


class Regression(StatefulProcessor):
    """For each game the weights of learn.gradient_scores(), their summed squares and the last draw learned from: a draw is scored by what the draws before it taught, then learned from. A draw that isn't later than the last one is left out, so a batch that comes again changes nothing."""

    def __init__(self, k: int, keys: list[str]):
        self.k, self.keys = k, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getValueState("weights", "w array<double>, seen array<double>, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        w, seen, last = self.weights.get() if self.weights.exists() else ([0.0] * len(self.keys), [0.0] * len(self.keys), -1)
        w, seen, out = np.array(w, float), np.array(seen, float), []
        new = pd.concat(list(rows)).sort_values(["t", "n"])
        for t, draw in new[new["t"] > last].groupby("t"):
            x, hit = draw[self.keys].to_numpy(float), draw["hit"].to_numpy(float)
            out.append(pd.DataFrame({"game": key[0], "t": t, "n": draw["n"].to_numpy(), "logit": x @ w}))
            if len(x) == self.k and not np.isnan(hit).any():
                w, seen = learned(w, seen, x, hit)
                last = int(t)
        self.weights.update((w.tolist(), seen.tolist(), last))
        yield pd.concat(out) if out else pd.DataFrame({"game": [], "t": [], "n": [], "logit": []}).astype({"game": object, "t": "int64", "n": "int32", "logit": float})

    def close(self) -> None:
        pass


def scored(signals: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """game, t, n, logit of each micro-batch of normalised signals (game, t, n, hit and keys; all k numbers of a draw in one batch, draws in order)."""
    return signals.groupBy("game").transformWithStateInPandas(Regression(k, keys), "game string, t long, n int, logit double", "Append", "None")
