"""Approximate nearest neighbours by counting collisions of single projections."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 300  # of a small block, so many are verified at least
RESULT = "query_id long, vec_id long, score double"


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one component more, so that all have the length `most`: the largest inner product is then the smallest distance."""
    return np.column_stack([x, np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0.0))])


def block_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, most: float, k: int, projections: int, threshold: float, share: float, growth: float = 1.15, seed: int = 11) -> pd.DataFrame:
    """For each query, the best k found among the vectors of one block.

    Every projection keeps its own sorted array of the block. A query opens a window around its own projection in each, `growth` times as wide at every step; the windows need no
    tables of their own (virtual rehashing), as a window is a range of ranks. A vector collides with the query in the projections whose window holds it. Steps end at the first one at which
    `share` of the block, and k vectors, collide in at least `threshold` of the projections: those are verified by their inner products.
    """
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((vectors.shape[1] + 1, projections))
    base = _augmented(vectors, most) @ axes
    lengths = np.sqrt((queries * queries).sum(1, keepdims=True))
    at = np.column_stack([queries / lengths * most, np.zeros(len(queries))]) @ axes
    ordered = np.sort(base, axis=0)
    rank = np.empty((projections, len(vectors)), np.uint16)
    for j in range(projections):
        rank[j, np.argsort(base[:, j], kind="stable")] = np.arange(len(vectors))
    unit = max(float(base.std()), 1e-12) * 0.25
    need, wanted = int(np.ceil(threshold * projections)), min(len(vectors), k + 1 + max(LEAST, int(share * len(vectors))))
    edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def collisions(i: int, step: int) -> np.ndarray:
        if step not in edges:
            half = unit * growth**step
            edges[step] = tuple(np.stack([np.searchsorted(ordered[:, j], at[:, j] + s * half, side=side) for j in range(projections)], 1) for s, side in ((-1, "left"), (1, "right")))
        low, high = edges[step][0][i], edges[step][1][i]
        inside = (rank - low.astype(np.uint16)[:, None]) < (high - low).astype(np.uint16)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if projections < 256 else np.uint16)

    out, step, last = [], 8, 200
    for i in range(len(queries)):
        count = collisions(i, step)
        enough = (count >= need).sum() >= wanted
        while not enough and step < last:  # wider
            step += 1
            count = collisions(i, step)
            enough = (count >= need).sum() >= wanted
        while step > 0:  # or narrower, if that is still enough
            fewer = collisions(i, step - 1)
            if (fewer >= need).sum() < wanted:
                break
            count, step = fewer, step - 1
        chosen = np.flatnonzero(count >= need) if enough else np.arange(len(vectors))
        chosen = chosen[ids[chosen] != query_ids[i]]
        score = (vectors[chosen] * queries[i]).sum(1)
        if len(chosen) > k:
            bound = np.partition(score, len(score) - k)[len(score) - k]
            chosen, score = chosen[score >= bound], score[score >= bound]
        best = np.lexsort((ids[chosen], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[chosen[best]], score[best]))
    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    return pd.DataFrame({"query_id": np.asarray(q, np.int64), "vec_id": np.asarray(v, np.int64), "score": np.asarray(s, float)})


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, projections: int = 128, threshold: float = 0.55, share: float = 0.25, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best by inner product, ties to the smaller id.

    All vectors are indexed, by blocks of a hash of the id (about `block` rows; at most 65,535); queries meet every block in groups of about `query_block`, so a task
    holds one block and one group whatever the size of the tables. Each block gives its best k, and the best k of all blocks stay. Scores are inner products of the
    vectors as given, in double precision; a query's own id is never found. Vectors that are null, zero, or hold a null or a component that isn't finite take no part,
    nor do rows without an id; vectors of other dimensions than a query's aren't compared with it. Rows that repeat an id are each a candidate. With no more than k
    candidates all are returned; an empty table gives an empty result.
    """
    as_double = F.transform(F.col(vector), lambda x: x.cast("double"))

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col(key).cast("long").alias("id"), as_double.alias("v")).where(F.col("id").isNotNull() & fine).withColumn("dim", F.size("v"))

    base, asked = usable(vectors), usable(queries)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, most = base.agg(F.count(F.lit(1)), F.max(norm)).first()
    n_asked = asked.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-n_asked // query_block))

    def spread(df: DataFrame, column: str, number: int, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id", F.lit(column)), F.lit(number)).cast("int").alias(column)
        return df.select("id", "v", "dim", own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = spread(base, "b", blocks, "g", groups).groupBy("b", "g", "dim")
    right = spread(asked, "g", groups, "b", blocks).groupBy("b", "g", "dim")

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, q = x.sort_values("id", kind="stable"), q.sort_values("id", kind="stable")
        parts = []
        for a in range(0, len(x), 65_000):
            part = x.iloc[a : a + 65_000]
            parts.append(block_search(np.vstack(q["v"]), q["id"].to_numpy(), np.vstack(part["v"]), part["id"].to_numpy(), float(most), k, projections, threshold, share))
        return pd.concat(parts)

    found = left.cogroup(right).applyInPandas(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
