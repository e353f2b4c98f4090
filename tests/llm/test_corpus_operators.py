"""Near duplicates, neighbours, quality, shards and mixes."""

import collections
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.llm import ann, darts, mixing, rules, sharding


def plain_classes(docs):
    """doc_id and text to class, by comparing all texts."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = list(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else [tuple(w)]
        sets[d] = frozenset((g, k) for g, n in collections.Counter(grams).items() for k in range(n))  # weighted: the second copy of a shingle is another element
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return " ".join(out)


def test_classes_as_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    docs = []
    for _ in range(60):
        docs.append(" ".join(r.choice(vocab) for _ in range(r.randint(1, 200))))
    base = [r.choice(vocab) for _ in range(150)]
    docs += [edited(base, k % 12, r) for k in range(150)]  # a large group of which some are linked
    passage = " ".join(r.choice(vocab) for _ in range(60))
    docs += [passage + " " + " ".join(r.choice(vocab) for _ in range(r.randint(5, 80))) for _ in range(60)]  # a passage that many share
    docs += [docs[3], docs[3].upper(), docs[70] + "  ", "", " \n", "", "one two", "one  two", "one two three"]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in darts.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_classes_of_one_template(spark, monkeypatch):
    """Texts of one template, each 0.74 like any other, and texts of the same few sentences, in which nothing is rare: classes as by brute force, and of the templated ones few pairs are met at last."""
    r = random.Random(5)
    rows = []
    for i in range(300):
        filled = [f"t{j}" for j in range(204)]
        for slot in range(17, 204, 34):
            filled[slot] = f"f{r.randrange(100)}"
        rows.append((i, " ".join(filled)))
    sentences = [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(20)]
    rows += [(1000 + i, " ".join(x for x in sentences if r.random() > 0.12)) for i in range(100)]
    pairs, plain = [], darts._verified
    monkeypatch.setattr(darts, "_verified", lambda p, *rest: pairs.append(p.select("a", "b").distinct().count()) or plain(p, *rest))
    got = {x.doc_id: x.class_id for x in darts.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)
    assert sum(pairs[-2:]) < len(rows), pairs  # of 44,850 pairs of the templated texts


def test_kept_by_row(spark):
    words = [f"w{i}" for i in range(40)]
    near, other, third = " ".join([*words[:-1], "x"]), " ".join(words[::-1]), "quite another text of a few words"
    rows = [(1, " ".join(words)), (1, other), (1, near), (2, other.upper()), (None, near), (None, third), (None, third), (3, "the one text of three")]
    got = darts.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) in [sorted([(0, third), (1, other), (3, "the one text of three"), (1, x)]) for x in (" ".join(words), near)]


def test_kept_writes_few_files_and_deals_texts_out_once(spark, monkeypatch):
    """A small table that many tasks find is written in one file, and the texts kept are shuffled once (besides the heads)."""
    files, plain = [], darts.materialise

    def written(df, name, *rest):
        out = plain(df, name, *rest)
        files.append((name, len(list(Path(out._scratch_path.removeprefix("file://")).glob("part-*")))))
        return out

    monkeypatch.setattr(darts, "materialise", written)
    rows = [(100 * g + i, " ".join([*[f"g{g}w{j}" for j in range(60)], *[f"end{i}"] * (i > 0)])) for g in range(30) for i in range(3)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = darts.kept(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [100 * g for g in range(30)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {n for name, n in files if name in ("links", "held")} <= {0, 1}, files
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_repeated_lines_weigh(spark):
    line = "this same line again and again "
    rows = [(1, line * 40 + "tail one two three four"), (2, line * 39 + "tail one two three four"), (3, line * 4 + "tail one two three four")]
    got = {r.doc_id: r.class_id for r in darts.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} == plain_classes(rows)


def test_classes_of_odd_documents(spark, odd_docs):
    rows = darts.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert by[6] == by[1] == 1 and by[2] == by[3] == by[7] == 2 and by[5] == 5
    assert {r.class_id for r in rows if r.doc_id is None} == {None, 2}
    kept = darts.kept(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 8, 9]  # the row of nulls is a copy of 2, the other without an id is not
    assert darts.classes(odd_docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, 501), (501, 500), (7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.comp for x in darts.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == root(n) for n in parent)


def test_stars_are_read_without_a_shuffle(spark):
    edges = [(1, 2), (2, 3), (3, 4), (7, 9)]
    parts = darts._starred(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(tuple(r) for r in parts.collect()) == [(2, 1), (3, 1), (4, 1), (9, 7)]
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_last_contents_meet_all_outside_the_largest_part(spark, monkeypatch):
    """Without pivots and rare elements all links but the first stars' come from the last comparison: they are those of brute force, and rows of the largest part never meet."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(60)]
        for _ in range(60):
            words = list(base)
            for at in rng.choice(60, int(rng.integers(1, 5)), replace=False):
                words[at] = f"v{g}y{rng.integers(3)}"
            rows.append((len(rows), " ".join(words)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) - 1e-9]
    head = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            head[i] = head[j] = min(head[i], head[j])
    assert 3 < len(set(head)) < len(rows)
    met, plain = [], darts._near
    monkeypatch.setattr(darts, "PIVOTS", 0)
    monkeypatch.setattr(darts, "FEW", 1)
    monkeypatch.setattr(darts, "_near", lambda rest, *more: met.append({b: [(r.comp, r.outside) for r in rest.where(rest.band == b).collect()] for b in [x.band for x in rest.select("band").distinct().limit(5).collect()]}) or plain(rest, *more))
    got = {x.doc_id: x.class_id for x in darts.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(head))
    assert met[0]
    for of in met[0].values():
        inside = {c for c, outside in of if not outside}
        assert len(inside) == 1 and not any(c in inside for c, outside in of if outside)
        assert sum(not outside for _, outside in of) == max(collections.Counter(c for c, _ in of).values())


def test_signatures_meet_as_often_as_weights_agree():
    rng = np.random.default_rng(7)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.uniform(0.1, 20, 200), rng.uniform(0.1, 20, 200)
    s = darts.signatures(np.repeat([0, 1], 200), np.r_[e, e], np.r_[a, b], 3, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03 and not s[2].any()


def truth(vectors, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted(((-float((np.asarray(x, float) * np.asarray(v, float)).sum()), i) for i, v in vectors if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 24))
    v = [(i, (centres[i % 12] * (i % 3) + rng.standard_normal(24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    rows = ann.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", block=400).collect()
    want = truth([(i, np.float32(x)) for i, x in v], [(i, np.float32(x)) for i, x in v if i % 20 == 0], 20)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert sum(len({i for i, _ in got[q]} & set(want[q])) for q in want) >= 0.9 * 20 * len(want)
    exact = {i: np.float64(np.float32(x)) for i, x in v}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-9 for i, s in found)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (20, [2.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    rows = ann.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0)]
    assert ann.search(df.limit(0), df.where("vec_id = 0"), "vec_id", "embedding").count() == 0
    assert ann.search(df, df.limit(0), "vec_id", "embedding").count() == 0


def test_quality(spark, odd_docs):
    r = random.Random(10)
    vocab = ["the", "of", "water", "stone", "river", "light", "house", "garden", "winter", "paper"]
    good = lambda: " ".join(r.choice(vocab) + str(r.randrange(50)) for _ in range(r.randint(20, 90))) + "."
    bad = lambda: r.choice([lambda: "BUY NOW!! " * r.randint(10, 40), lambda: "x | y | z | " * r.randint(9, 40), lambda: "word " * 80])()
    docs = [(i, bad() if i % 5 == 0 else good()) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    ensemble = rules.fit(df, labels)
    rows = rules.scored(df.where("doc_id >= 400"), ensemble).collect()
    assert sum(x.predicted == int(x.doc_id % 5 > 0) for x in rows) >= 0.97 * len(rows)
    # the compiled expression is the ensemble
    x = rules.measured(df.where("doc_id >= 590"))
    for row in x.withColumn("s", rules.compiled(ensemble)).collect():
        total = ensemble.intercept + sum(w for rule, w in zip(ensemble.rules, ensemble.weights, strict=True) if all((row[f"stat_{c.statistic}"] > c.limit) == c.above for c in rule))
        assert abs(row.s - 1 / (1 + np.exp(-total))) < 1e-12
    odd = rules.scored(odd_docs, ensemble)
    assert odd.count() == odd_docs.count() and all(0 <= x.score <= 1 for x in odd.collect())
    assert rules.scored(odd_docs.limit(0), ensemble).count() == 0
    assert rules.fit(df, labels.limit(0)).rules == [] and rules.fit(odd_docs.limit(0), labels).rules == []


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_scored_sends_a_text_to_python_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "fr")], "doc_id long, text string, lang string")
    sent, plain = [], rules.measured
    monkeypatch.setattr(rules, "measured", lambda d, *more: sent.append(d) or plain(d, *more))
    ensemble = rules.Ensemble([], [], 0.0)
    rows = rules.scored(docs, ensemble)
    assert rows.columns == ["doc_id", "text", "lang", "score", "predicted"]
    assert [tuple(r) for r in rows.orderBy("doc_id").collect()] == [(1, "some words", "en", 0.5, 0), (2, None, "fr", 0.5, 0)]
    assert sum(tuple(r).count("some words") + list(r[0]).count("some words") for r in sent[0].collect()) == 1
    assert rules.scored(docs.select("text"), ensemble).columns == ["text", "score", "predicted"]
    assert rules.scored(docs.select("text"), ensemble).count() == 2


def test_shards(spark, odd_docs):
    df = spark.createDataFrame([(i * 977 - 5000,) for i in range(3000)], "k long").withColumn("shard", F.lit("old")).withColumn("_block", F.lit(1))
    rows = sharding.place(df, "k", 16).collect()
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.k % 2**64, 16), jump(r.k % 2**64, 17))
        assert r.grown_shard in (r.shard, 16)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    odd = sharding.place(odd_docs, "doc_id", 4)
    assert odd.count() == odd_docs.count() and sharding.place(odd_docs.limit(0), "doc_id", 4).count() == 0


def water(sizes, weights, cap):
    """Targets by sharing again and again."""
    target, free = {}, dict(sizes)
    left = float(sum(sizes.values()))
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            del free[s]
    return target


def test_mix(spark, odd_docs):
    r = random.Random(11)
    names = ["a", "b", "c", "d", None]
    rows = [(i, names[min(int(r.expovariate(0.7)), 4)], r.choice([0, 1, 5, 40, 300, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("_words", F.lit("mine"))
    got = mixing.mix(df, "source", "size", ["doc_id"]).collect()
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 and x.source_size == sizes[x.source] and x._words == "mine"
        assert 0 <= x.taken <= 3 * (x.size or 0) and (x.position is None) == (x.taken == 0)
        taken[x.source] += x.taken
    assert len(got) == 2000 and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(7), "source", "size", ["doc_id"])
    assert {(x.doc_id, x.taken, x.position) for x in got} == {(x.doc_id, x.taken, x.position) for x in again.collect()}
    odd = mixing.mix(odd_docs.withColumn("words", F.length("text")), "source", "words", ["doc_id", "text"])
    assert odd.count() == odd_docs.count() and mixing.mix(odd_docs.limit(0), "source", "size", ["doc_id"]).count() == 0


def test_repeats_are_laid_along_the_whole_run(spark):
    rows = [(i, "a" if i < 40 else "b", 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(df, "source", "size", ["doc_id"])
    for x in mixed.where("source = 'a'").collect():
        assert x.taken == 30 and len(x.positions) == 3 and x.positions[0] == x.position and x.positions == sorted(x.positions)
        demand = [p - 0.5 * (p * p - p) for p in x.positions]  # the first of two sources fades
        assert all(abs(b - a - 1 / 3) < 1e-9 for a, b in zip(demand, demand[1:], strict=False))
    order = mixing.in_order(mixed).select("doc_id", "source", "position").collect()
    at = [x.position for x in order]
    assert at == sorted(at) and sum(x.source == "a" for x in order) == 120
    late = sum(x.source == "a" and x.position >= 0.5 for x in order)
    assert abs(late - 45) <= 1  # 1 - (1.5 t - 0.5 t^2) of 120 uses; first uses alone end at t = 0.24


@pytest.mark.parametrize("slope", [-0.5, -0.2, 0.0, 0.3, 0.5])
def test_positions_invert_the_schedule(spark, slope):
    t = spark.range(11).select((F.col("id") / 10).alias("t")).withColumn("d", F.col("t") + slope * (F.col("t") * F.col("t") - F.col("t")))
    assert all(abs(r.p - r.t) < 1e-9 for r in t.withColumn("p", mixing.position(F.col("d"), F.lit(slope))).collect())


def test_mixing_query_orders_all_uses(spark, monkeypatch):
    """op10's rows come from every use of a document, put in order of position."""
    from drawlens.llm import queries

    orders, plain = [], mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda *a: orders.append(plain(*a)) or orders[-1])
    rows = queries.op10_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(orders) == 1
    uses = orders[0].collect()
    at = [x.position for x in uses]
    assert at == sorted(at) and all(0 < x.words <= x.size for x in uses)
    by_row, first = collections.Counter(), {}
    for x in uses:
        by_row[x.row] += x.words
        first.setdefault(x.row, x.position)
    assert sorted(n for n in by_row.values()) == sorted(x.taken for x in rows if x.taken)
    assert sorted(round(p, 9) for p in first.values()) == sorted(x.position for x in rows if x.taken)
    assert all((x.position is None) == (x.taken == 0) for x in rows) and len(uses) > len(by_row)
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
