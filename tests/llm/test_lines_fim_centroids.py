"""Line dedup, fill-in-middle and centroid clustering against plain Python."""

import hashlib
import random
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.llm import centroids, fim, line_runs, oracles, queries

SF = "/root/testdata/sf0.001"


def plain_dedup(rows, least=10):
    """rows: (doc_id, text). The kept text and the number of lost lines of each."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    order = lambda d: (d is None, d or 0)
    held = {}
    for d, lines in split:
        for x in lines:
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    owner = {k: min(v, key=order) for k, v in held.items() if len(v) > 1}
    out = []
    for d, lines in split:
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (5, 2), (7, 3)])
def test_lines_by_batches_and_levels(spark, batches, fan):
    r = random.Random(batches)
    pool = [" ".join(r.choice("ab cd EF éÉ ß x".split()) for _ in range(r.randint(1, 6))) for _ in range(60)]
    dress = lambda x: r.choice(["", " ", "\t", "\r"]) + r.choice([x, x.upper(), x.lower()]) + r.choice(["", " ", "\x0b", "\x0c \r"])
    rows = [(i * 3 - 40, "\n".join(dress(r.choice(pool)) for _ in range(r.randint(0, 9))) + r.choice(["", "\n", "\n\n"])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_runs.dedup(df, batches=batches, fan=fan)) == plain_dedup(rows)


def test_lines_of_odd_documents(spark, odd_docs):
    shared = "a line that several hold\n"
    more = [(20, shared * 3 + "short"), (21, "SHORT\n" + shared + "own line of this one"), (None, shared + "no id here"), (22, shared), (22, shared), (1, "second text of one id\n" + shared), (23, "\n".join(f"line number {i % 7} of many" for i in range(20_000))), (24, "line number 3 of many")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumn("n_lines", F.lit("taken")).withColumn("batch", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = line_runs.dedup(docs, batches=3)
    assert found(out) == plain_dedup(rows)
    assert {"lang", "kind", "_row", "batch"} <= set(out.columns) and "text" not in out.columns
    assert line_runs.dedup(docs.limit(0)).count() == 0
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("drawlens_run")] == []


def test_lines_of_a_hot_line(spark):
    """A line of a third of all rows is hot, others are not; both ways give what plain Python gives."""
    rows = [(i, ("the very common line\n" if i % 2 else "") + f"line of document {i % 4000}\nown {i} of mine") for i in range(6000)]
    assert found(line_runs.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=2)) == plain_dedup(rows)


def test_runs_stay_few(spark):
    runs = line_runs.Runs(spark, buckets=2, fan=2)
    for i in range(9):
        keys = spark.createDataFrame([(j, j, j, False, 1) for j in range(i * 5, i * 5 + 10)], "a long, b long, owner long, several boolean, n long")
        assert runs.add(keys).where("seen").count() == (5 if i else 0)
        assert all(len(level) <= 2 for level in runs.levels) and len(runs.levels) <= 4
    left = [name for level in runs.levels for name in level]
    assert sum(runs._keys(n).count() for n in left) == 50
    runs.close()


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc, text):
    text = text or ""
    u = UNITS.findall(text)
    n = len(u)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, m, z = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


def test_fim_against_tokens(spark, odd_docs):
    r = random.Random(5)
    extra = ["".join(r.choice(list("ab <>PSM\t\n\x0b\x0c\réß") + ["\U0001f600", "<P", "P>", "  ", "<S>"] * (i % 9 == 0)) for _ in range(r.randint(0, 60))) for i in range(300)]
    extra += [" ", "\n\n", "x", " x", "x ", "   x", "<M>", "ab " * 30_000, "x" * 100_000]
    docs = odd_docs.unionByName(spark.createDataFrame([(i + 100, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True).withColumn("t", F.col("text")).withColumn("form", F.lit(0))
    rows = fim.rearranged(docs).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_fim(x.doc_id, x.t)
        assert x.again == (x.t or "")
    assert fim.rearranged(docs.limit(0)).count() == 0


def plain_lloyd(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    cs = [q for _, q in first[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        groups = [[q for (_, q), a in zip(kept, at, strict=True) if a == j] for j in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    total = {j: sum(d for _, c, d in out if c == j) for j in range(len(cs))}
    return sorted(((i, c, d, total[c], sum(total.values()), cs[c]) for i, c, d in out), key=str)


def clustered(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect()), key=str)


def test_centroids_against_plain_lloyd(spark):
    r = random.Random(2)
    vector = lambda: [r.uniform(-1, 1) for _ in range(64)]
    same = vector()
    rows = [(i, vector()) for i in range(150)] + [(200 + i, same) for i in range(80)] + [(5, same), (5, same), (None, vector()), (None, None), (301, None), (302, []), (303, same[:63]), (304, [*same, 1.0]), (305, [None, *same[1:]]), (306, [float("nan"), *same[1:]]), (307, [float("-inf"), *same[1:]]), (308, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("old")).withColumn("_q", F.lit(1)).repartition(3)
    out = centroids.cluster(df, "vec_id", "embedding")
    assert "_q" in out.columns and clustered(out) == plain_lloyd(rows)
    few = rows[:3] + [(9, None)]
    assert clustered(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"), "vec_id", "embedding")) == plain_lloyd(few)
    assert centroids.cluster(df.limit(0), "vec_id", "embedding").count() == 0
    assert centroids.cluster(df.where("vec_id = 301"), "vec_id", "embedding").count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e7] * 64)], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()


@pytest.mark.parametrize("name", ["op11_lines", "op12_fim", "op13_centroids"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
    assert oracles.op11() and len(names) == len(set(names))
