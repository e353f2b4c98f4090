"""The stages of the pipeline, each against a plain version on its own input."""

import base64
import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drawlens.llm import bpe, darts, mixing, pii, rules
from drawlens.llm.queries import held_out

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def plain_targets(total):
    """Targets by sharing all words by weight, again and again until no source is above three times its size."""
    names = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    done = {}
    while True:
        rest = [s for s in names if s not in done]
        left = sum(total.values()) - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * total[s]]
        if not over:
            return done | share
        done |= {s: 3 * total[s] for s in over}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            share = lambda q: sum(d in kept for d, x in labels.items() if x == q) / sum(x == q for x in labels.values())
            assert share(1) >= 0.97 and share(0) <= 0.3  # this little table has some 60 labels to learn from
        if name == "near_duplicates":
            firsts = {r.doc_id for r in darts.classes(docs).where("doc_id = class_id").collect()}
            assert sorted(r.doc_id for r in rows) == sorted(firsts)
        if name == "personal_data":
            assert len(rows) == len(before)
            for r in rows:
                assert r.n_chars == len(r.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", r.text)
        if name == "mixed":
            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
            source = {r.doc_id: r.source for r in before}
            uses = collections.Counter(r.doc_id for r in rows)
            assert uses.keys() <= size.keys() and max(uses.values()) <= 3
            total = collections.Counter()
            for d, n in size.items():
                total[source[d]] += n
            for s, target in plain_targets(total).items():
                taken = sum(n * size[d] for d, n in uses.items() if source[d] == s)
                assert target - 1 <= taken <= target + max(n for d, n in size.items() if source[d] == s), s
        if name == "encoded":
            with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            digest = lambda t: hashlib.sha256(",".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest()
            assert collections.Counter((r.doc_id, r.ids_sha256) for r in rows) == collections.Counter((r.doc_id, digest(r.text)) for r in before)
        names.append(name)
        docs = after
    assert names == ["quality", "near_duplicates", "personal_data", "mixed", "encoded"]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.limit(4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]])
    both = docs.unionByName(odd).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, both, SF).count() >= 0, name
    assert all((bpe, mixing, pii, rules, held_out))
