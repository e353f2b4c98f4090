"""Lloyd's clustering of quantised vectors, over distinct vectors with their multiplicities."""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.llm.scratch import drop, materialise

LIMIT = 1 << 27  # of components: squared distances of 64 of them fit a BIGINT
HOT = 4096  # a vector of more than this part of the rows is hot: there are fewer hot vectors than this


def quantised(rows: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """The rows whose vector has exactly dims components, none null or not finite, with _q: floor(scale * x) of each. A component of 2**27 or more is an error, as distances would not fit a BIGINT."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size(v) == dims) & finite)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    large = F.exists(v, lambda x: F.abs(x.cast("double")) * scale >= LIMIT)
    return rows.withColumn("_q", F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(whole))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the number of its nearest centroid (ties: the smaller) and the squared distance, as whole numbers."""
    d = np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(q)), at]


def _moved(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round. Each task sums its vectors, times their multiplicities, into one row for each centroid and component; the driver gets as many rows as the centroids have components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        whole = np.zeros((len(c), dims + 1), object)  # of Python's integers, which don't overflow
        for batch in batches:
            q, w = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            at, _ = nearest(q, c)
            kind = np.int64 if int(w.max(initial=0)) * len(w) < 1 << 36 else object
            for i in np.unique(at):
                mine = at == i
                weights = w[mine].astype(kind)
                whole[i] += np.r_[(q[mine].astype(kind) * weights[:, None]).sum(0), weights.sum()].astype(object)
        cells = [(i, j, Decimal(int(whole[i, j]))) for i in range(len(c)) for j in range(dims + 1) if whole[i, dims]]
        if cells:
            number, place, total = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["c", "j", "s"])

    table = distinct.mapInArrow(sums, "c int, j int, s decimal(38,0)").groupBy("c", "j").agg(F.sum("s").alias("s"))
    total = {(r.c, r.j): int(r.s) for r in table.collect()}
    return [[total[i, j] // total[i, dims] for j in range(dims)] if (i, dims) in total else old for i, old in enumerate(centroids)]


def _assigned(distinct: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """distinct with cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            at, d = nearest(_matrix(batch.column(0), dims), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["_q", "_w", "cluster", "distance"])

    return distinct.mapInArrow(run, "_q array<long>, _w long, cluster int, distance long")


def cluster(rows: DataFrame, key: str, vector: str, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """The rows with a whole vector, without it, with cluster, distance (squared), cluster_inertia, inertia and centroid (of the cluster, at the end).

    Vectors are quantised to whole numbers and grouped; each round reads the distinct ones, a written table, and sends the driver k * (dims + 1) sums. The first centroids are the k vectors with the smallest sha256 of seed and key, ties
    to the smaller vector (fewer, if there are fewer vectors). At the end the assignments are joined back by vector: vectors of more than one row in HOT, fewer than HOT of them, by a broadcast, the others by a shuffle in which no vector has more rows
    than that.
    Vectors that are null, of another length or with components that are null or not finite have no row. Equal vectors have equal results; a null key counts as the empty string in the hash; an empty table gives an empty result; columns of
    rows that bear a name of the result are replaced.
    """
    spark = rows.sparkSession
    made = {"cluster", "distance", "cluster_inertia", "inertia", "centroid"}
    others = [c for c in rows.columns if c != vector and c not in made]
    base = quantised(rows.select(F.struct(*[rows[c] for c in others]).alias("_kept"), rows[vector].alias("_v"), F.coalesce(rows[key].cast("string"), F.lit("")).alias("_key")), "_v", dims, scale)
    distinct = materialise(base.groupBy("_q").agg(F.count(F.lit(1)).alias("_w")), "distinct")
    digest = F.sha2(F.concat(F.lit(seed), F.col("_key")).cast("binary"), 256)
    centroids = [list(r[1]) for r in base.select(digest.alias("h"), "_q").orderBy("h", "_q").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(distinct, centroids, dims)
    assigned = materialise(_assigned(distinct, centroids, dims), "assigned") if centroids else distinct.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
    facts = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("_w")).alias("s"), F.sum("_w").alias("n")).collect()  # k rows
    inertia, total = {r.cluster: int(r.s) for r in facts}, sum(r.n for r in facts)
    table = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), c) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    hot = F.broadcast(assigned.where(F.col("_w") * HOT > total).drop("_w"))
    rest = assigned.where(F.col("_w") * HOT <= total).drop("_w")
    base = base.select("_kept", "_q")
    both = base.join(hot, "_q").unionByName(base.join(hot.select("_q"), "_q", "left_anti").join(rest, "_q"))
    if centroids:
        drop(distinct)
    return both.join(F.broadcast(table), "cluster").select(*[F.col(f"_kept.`{c}`").alias(c) for c in others], "cluster", "distance", "cluster_inertia", "inertia", "centroid")
