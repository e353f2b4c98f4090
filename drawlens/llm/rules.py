"""A quality classifier: rules from tree paths over text statistics, weighted by a lasso and compiled into column expressions."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlens.llm.lm import END, Tokens, slices

STATISTICS = ["words", "word_length", "distinct", "repeats", "upper", "capitals", "digits", "symbols", "bars", "marks", "stops", "lines", "wide", "longest"]


class Condition(NamedTuple):
    statistic: str
    above: bool  # else at most
    limit: float


Rule = tuple[Condition, ...]


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    intercept: float


class _Measures:
    def __init__(self) -> None:
        self.tokens = Tokens()
        classes = np.zeros((9, 256), bool)
        for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#$%&*+<>=@\\^_`{}~[]/", "|", "!?", ".,;:", "\n")):
            classes[k, list(chars.encode())] = True
        classes[8, 128:] = True
        self.classes = classes

    def of(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The statistics of the texts that end at `ends` in data: one row for each text."""
        n = len(ends)
        starts = np.r_[0, ends[:-1]]

        def total(mask: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(mask)]
            return (sums[ends] - sums[starts]).astype(float)

        upper, lower, digits, symbols, bars, marks, stops, lines, wide = (total(c[data]) for c in self.classes)
        h, text = self.tokens.read(data, ends)
        last = np.r_[text[1:] != text[:-1], True]
        own = np.bincount(text, minlength=n) - 1.0
        h, text = h[~last], text[~last]
        words = np.maximum(own, 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        pairs = np.unique((text.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
        distinct = np.bincount((pairs >> np.uint64(43)).astype(np.int64), minlength=n)
        filled = total(~self.tokens.gap[data])
        runs = np.zeros(n)
        if len(h):  # the longest stretch of one word again and again
            i = np.arange(len(h))
            length = i - np.maximum.accumulate(np.where(again, 0, i))
            np.maximum.at(runs, text, length)
        letters = np.maximum(upper + lower, 1)
        # Of a capital and a small letter with an accent, the second bytes differ in bit 5.
        lead = np.r_[False, data[:-1] == 0xC3] if len(data) else np.zeros(0, bool)
        accented = total(lead & (data < 0xA0))
        return np.column_stack([own, filled / words, distinct / words, np.bincount(text, again, n) / words, upper / letters, (upper + accented) / words, digits / words, symbols / words, bars / words, marks / words, stops / words, lines / words, wide / np.maximum(filled, 1), runs])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the STATISTICS of the text: columns stat_<name>. A null text counts as empty, whose statistics are 0."""
    made = [f"stat_{s}" for s in STATISTICS]
    kept = [c for c in docs.columns if c not in made]
    at = kept.index(text)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(m, T.DoubleType()) for m in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = _Measures()
        for batch in batches:
            for lo, hi, data, ends in slices(batch.column(at), 1 << 20):
                values = measures.of(data, ends)
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns] + [pa.array(v) for v in values.T], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> list[tuple[tuple, float]]:
    """The paths of a regression tree for gradients g and curvatures h, with the step at each leaf; all nodes on the way are paths too."""
    out = []

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            out.append((path, -g[rows].sum() / (h[rows].sum() + 1.0)))
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-3, -1, 0.0)
        all_g, all_h = g[rows].sum(), h[rows].sum()
        for f, limits in enumerate(cuts):
            bin_of = np.searchsorted(limits, x[rows, f], side="left")
            n = np.cumsum(np.bincount(bin_of, minlength=len(limits) + 1))[:-1]
            sg = np.cumsum(np.bincount(bin_of, g[rows], len(limits) + 1))[:-1]
            sh = np.cumsum(np.bincount(bin_of, h[rows], len(limits) + 1))[:-1]
            gain = sg**2 / (sh + 1) + (all_g - sg) ** 2 / (all_h - sh + 1) - all_g**2 / (all_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], f, limits[k])
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            grow(rows[low], (*path, (best[1], False, float(best[2]))))
            grow(rows[~low], (*path, (best[1], True, float(best[2]))))

    grow(np.arange(len(x)), ())
    return out


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, limit in rule:
        out &= (x[:, f] > limit) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.001, steps: int = 400) -> Ensemble:
    """Boosted trees give the rules; a logistic lasso over all rules, by accelerated proximal gradient, gives the weights.

    x: rows of STATISTICS; y: 0 or 1. Rules that hold on the same rows of the sample are one rule. Without both labels the score is constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 60))) for f in range(x.shape[1])]
    margin = np.full(len(y), np.log(share / (1 - share)))
    found: dict[bytes, tuple] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for rule, step in (paths := _tree(x, p - y, p * (1 - p), cuts, depth, max(5, len(y) // 1000))):
            found.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
        leaves = [(r, s) for r, s in paths if not any(q[: len(r)] == r and len(q) > len(r) for q, _ in paths)]
        for rule, step in leaves:
            margin[holds(rule, x)] += 0.3 * step
    rules = list(found.values())
    a = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    w, b = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    rate = 4.0 / (np.linalg.norm(np.c_[a, np.ones(len(a))], 2) ** 2 / len(y))
    v, c, before = w.copy(), b, 1.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(a @ v + c))) - y) / len(y)
        new = v - rate * (a.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * e.sum()
        now = (1 + np.sqrt(1 + 4 * before**2)) / 2
        v, c = new + (before - 1) / now * (new - w), new_b + (before - 1) / now * (new_b - b)
        w, b, before = new, new_b, now
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    named = [tuple(Condition(STATISTICS[f], above, limit) for f, above, limit in rules[k]) for k in keep]
    return Ensemble(named, w[keep].tolist(), float(b))


def compiled(ensemble: Ensemble) -> Column:
    """The score, 0 to 1, as a column expression over the stat_ columns."""
    total = F.lit(ensemble.intercept)
    for rule, weight in zip(ensemble.rules, ensemble.weights, strict=True):
        tests = [F.col(f"stat_{c.statistic}") > c.limit if c.above else F.col(f"stat_{c.statistic}") <= c.limit for c in rule]
        both = tests[0]
        for t in tests[1:]:
            both = both & t
        total = total + F.when(both, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 16_000, **how) -> Ensemble:
    """Rules learned from at most `sample` labelled rows, those with the smallest hashes of their keys; labels that are null are left out.

    The sample of labels is bounded, so its keys are broadcast to the documents, and only its documents are measured.
    """
    some = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull()).select(key, F.col(target).cast("int").alias("_label")).orderBy(F.xxhash64(key), "_label").limit(sample)
    rows = measured(docs.select(key, text).join(F.broadcast(some), key), text).select("_label", *[f"stat_{s}" for s in STATISTICS]).toPandas().to_numpy(float)
    rows = rows[np.lexsort(rows.T[::-1])]  # in an order of its own, whatever the partitions
    return fit_rules(rows[:, 1:], rows[:, 0], **how)


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text", least: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score is at least `least`). Nulls and empty texts are scored like any other text;
    columns of docs that bear a name of the result are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    others = [c for c in kept if c != text]  # the text goes to Python once, and back
    rows = measured(docs.select(*[F.struct(*[docs[c] for c in others]).alias("_kept")] * bool(others), F.col(text).alias("text"))).withColumn("score", compiled(ensemble))
    return rows.select(*[F.col("text" if c == text else f"_kept.`{c}`").alias(c) for c in kept], "score", (F.col("score") >= least).cast("int").alias("predicted"))
