"""BPE, GIF and language-model scoring."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.llm import bpe, gif, lm

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, odd_docs, encoding):
    r = random.Random(3)
    extra = ["".join(r.choice("aeinrst \n\t12éß中\U0001f600=") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["a" * 3000, " " * 3000 + "x", "ab" * 900]
    docs = odd_docs.unionByName(spark.createDataFrame([(i + 100, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    rows = bpe.tokenised(docs.withColumn("t", F.col("text")), PATH, tokenizers.PATTERN, chunk=20_000).collect()
    assert len(rows) == docs.count()
    for x in rows:
        want = encoding.encode_ordinary(x.t or "")
        assert x.ids == want and x.n_tokens == len(want)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((x.t or "").encode()).hexdigest()
    assert bpe.tokenised(docs.limit(0), PATH, tokenizers.PATTERN).count() == 0


def test_a_merge_that_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"bb": 258}
    enc = tiktoken.Encoding("t", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(random.Random(i).choice("ab") for _ in range(i % 14 + 1)) for i in range(300)]
    ids, starts = bpe.replay(bpe.Vocabulary(ranks), [w.encode() for w in words])
    assert [ids[starts[i] : starts[i + 1]].tolist() for i in range(300)] == [enc.encode_ordinary(w) for w in words]


def test_bpe_of_very_long_words(encoding):
    """Words of a megabyte, of one letter pair or of any letters, and many pairs that open lower ranks."""
    r = random.Random(4)
    vocab = bpe.Vocabulary.read(PATH)
    words = [b"ee" * 500_000, b"iv" * 100_000, b"a" * 300_001, bytes(r.choices(b"etaoinshrdlu", k=1_000_000)), bytes(r.choices(b"ab", k=200_000)), bytes(r.randrange(256) for _ in range(100_000))]
    began = time.monotonic()
    for w in words:
        ids, _ = bpe.replay(vocab, [w])
        if w.isascii():
            assert ids.tolist() == encoding._encode_single_piece(w)
        assert b"".join(vocab.bytes_of[i] for i in ids) == w
    assert time.monotonic() - began < 60


def test_lexicon_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe.Lexicon, "MOST_BYTES", 1000)
    vocab = bpe.Vocabulary.read(PATH)
    lexicon = bpe.Lexicon(vocab)
    for i in range(6):
        words = [chr(97 + i) * 600, "word", f"n{i}"]
        (used,) = lexicon.places([words])
        assert [b"".join(vocab.bytes_of[x] for x in lexicon.ids[lexicon.starts[u] : lexicon.starts[u + 1]]).decode() for u in used] == words
        assert len(lexicon.number) <= 6


def test_gif_round_trip(spark, odd_docs):
    rows = gif.features(gif.stored(odd_docs.withColumn("t", F.col("text")))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        raw = (r.t or "").encode()
        p = gif.padded(raw)
        assert len(p) % 576 == 0 and p and p.startswith(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({r.feature for r in rows if (r.t or "") == ""}) == 1
    assert gif.features(gif.stored(odd_docs.limit(0))).count() == 0
    by_hand = {r.doc_id: r for r in rows if r.doc_id in (1, 5)}
    for r in gif.stored(odd_docs).where("doc_id in (1, 5)").collect():
        shown = list(gif.frames(bytes(r.media)))
        counts = collections.Counter((int(p) >> 6 & 3) * 16 + (int(p) >> 14 & 3) * 4 + (int(p) >> 22 & 3) for f in shown for p in f.pixels.ravel() if int(p) >> 24)
        want = f"frames={len(shown)};ms={sum(f.delay_ms for f in shown)};colours=" + ",".join(f"{i}:{counts[i]}" for i in sorted(counts))
        assert by_hand[r.doc_id].feature == want and by_hand[r.doc_id].media_sha256 == hashlib.sha256(r.media).hexdigest() and by_hand[r.doc_id].media_bytes == len(r.media)
    odd = gif.features(spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a\1\0\1\0\0\0\0;"))], "id long, media binary")).orderBy("id").collect()
    assert odd[0].payload_bytes is None and odd[0].feature is None and odd[1].payload_bytes == 0


def textbook_decoder(data, bits):
    clear, size, at, out = 1 << bits, bits + 1, 0, b""
    table, last, number = [bytes([i]) for i in range(clear)] + [b"", b""], b"", int.from_bytes(data, "little")
    base = list(table)
    while True:
        code, at = number >> at & ((1 << size) - 1), at + size
        if code == clear:
            table, size, last = list(base), bits + 1, b""
        elif code == clear + 1:
            return out
        else:
            now = table[code] if code < len(table) else last + last[:1]
            if last and len(table) < 4096:
                table.append(last + now[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
            out, last = out + now, now


def test_media_by_another_decoder():
    r = random.Random(2)
    text = " ".join(r.choice(["the", "of", "and", "word", "text", "another", "frame"]) for _ in range(9000)).encode()
    for raw in (text, bytes(r.randrange(256) for _ in range(3000)), b"", b"a" * 5000):
        payload = gif.padded(raw)
        media = gif.encode([payload])[0]
        images = list(gif.Reader(media).images())
        assert b"".join(textbook_decoder(x.codes, x.bits) for x in images) == payload
        assert b"".join(x.tobytes() for x in gif.decoded(images)) == payload
    images = list(gif.Reader(gif.encode([gif.padded(text)])[0]).images())
    assert {x.disposal for x in images} == {0, 1, 2, 3} and {x.hole for x in images} == {None, 32} and len({x.delay_ms for x in images}) == 13 and len({x.palette.tobytes() for x in images}) > 1
    assert len(gif.encode([gif.padded(text)])[0]) < 0.9 * len(text)


def test_streams_that_end_early_or_err():
    whole = plain_lzw(bytes([1, 2, 3, 1, 2, 3, 1, 2, 3]), 2)
    early, both = gif.lzw([whole[:2]], 2)[0].tobytes(), gif.lzw([whole, whole[:2], b""], 2)
    assert bytes([1, 2, 3, 1, 2, 3, 1, 2, 3]).startswith(early) and both[0].tobytes() == bytes([1, 2, 3, 1, 2, 3, 1, 2, 3]) and both[1].tobytes() == early and not len(both[2])
    with pytest.raises(ValueError):
        gif.lzw([bytes([0b111100])], 2)  # after the clear, a code that no table has
    with pytest.raises(ValueError):
        list(gif.frames(b"not a picture"))


def plain_lzw(samples, bits):
    """A textbook LZW coder."""
    clear, size = 1 << bits, bits + 1
    table, acc, have, out, word = {bytes([i]): i for i in range(clear)}, 0, 0, bytearray(), b""

    def put(code):
        nonlocal acc, have
        acc |= code << have
        have += size
        while have >= 8:
            out.append(acc & 255)
            acc, have = acc >> 8, have - 8

    put(clear)
    next_ = clear + 2
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word])
        if next_ < 4096:
            table[word + bytes([s])] = next_
            next_ += 1
            if next_ - 1 == 1 << size and size < 12:
                size += 1
        word = bytes([s])
    put(table[word])
    put(clear + 1)
    if have:
        out.append(acc & 255)
    return bytes(out)


def made_gif(frames, palette, size, background=b"\0\0"):
    """frames: (left, top, w, h, samples, delay, disposal, hole or None, interlaced)."""
    w, h = size
    out = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x80 | 1]) + background + palette
    for left, top, fw, fh, samples, delay, disposal, hole, inter in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (hole is not None)]) + delay.to_bytes(2, "little") + bytes([hole or 0, 0])
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, fw, fh)) + bytes([0x40 if inter else 0, 2])
        data = plain_lzw(samples, 2)
        for i in range(0, len(data), 255):
            out += bytes([len(data[i : i + 255])]) + data[i : i + 255]
        out += b"\0"
    return out + b"\x3b"


def test_gif_rules(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    whole = bytes([1] * 8 + [2] * 8)
    g = made_gif([(0, 0, 4, 4, whole, 5, 1, None, False), (1, 1, 2, 2, bytes([3, 0, 0, 3]), 7, 2, 0, False), (0, 0, 1, 1, b"\x03", 9, 3, None, False), (0, 0, 4, 4, whole, 1, 0, None, True)], palette, (4, 4))
    f = list(gif.frames(g))
    rgba = lambda x, y, k: tuple(f[k].pixels.view(np.uint8).reshape(4, 4, 4)[y, x])
    assert [x.delay_ms for x in f] == [50, 70, 90, 10]
    assert rgba(1, 1, 1) == (0, 0, 255, 255) and rgba(2, 1, 1) == (255, 0, 0, 255)  # a hole shows what was there
    assert rgba(1, 1, 2) == (0, 0, 0, 0) and rgba(0, 0, 2) == (0, 0, 255, 255)  # cleared after frame 1
    assert [rgba(0, y, 3)[0] for y in range(4)] == [255, 0, 255, 0]  # rows of an interlaced frame come in passes
    assert gif.histograms([f[0].pixels])[0, 48] == 8 and gif.histograms([f[0].pixels])[0, 12] == 8
    rows = gif.timed_frames(spark.createDataFrame([(1, bytearray(g)), (2, None)], "id long, media binary")).orderBy("frame").collect()
    assert [(r.id, r.frame, r.delay_ms, r.width) for r in rows] == [(1, 0, 50, 4), (1, 1, 70, 4), (1, 2, 90, 4), (1, 3, 10, 4)] and sum(rows[0].histogram) == 16


def test_long_lzw_streams():
    r = random.Random(5)
    for n, top in ((20_000, 4), (20_000, 256), (5, 256)):
        samples = bytes(r.randrange(top) for _ in range(n))
        bits = 2 if top == 4 else 8
        assert gif.lzw([plain_lzw(samples, bits), plain_lzw(samples[:50], bits)], bits)[0].tobytes() == samples


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


def test_language_model(spark, odd_docs):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    corpus = [(i + 100, " ".join(vocab[min(int(r.paretovariate(0.7)), 299)] for _ in range(r.randint(0, 80)))) for i in range(300)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(corpus, "doc_id long, text string"))
    train = docs.where("doc_id is null or doc_id % 5 > 0")
    counts = collections.Counter(w for x in train.collect() for w in words(x.text))
    n, v = sum(counts.values()), len(counts)
    for head in (1 << 16, 20):  # all words in memory, or nearly all by the join
        model = lm.fit(train, head=head)
        rows = lm.score(docs.withColumn("t", F.col("text")), model).collect()
        assert len(rows) == docs.count()
        total = collections.Counter()
        for x in rows:
            own = words(x.t)
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert abs(x.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
            assert math.isfinite(x.score) and x.score <= 0
            total["score"] += x.score
            total["base"] += x.base_score
        assert total["score"] > total["base"]
        # the chances of all outcomes after any context sum to 1
        rest = model.words.select("w", "root", F.posexplode_outer("held").alias("i", "held"), "us").select("w", "root", "held", F.get("us", F.col("i")).alias("u")).collect()
        held, roots = np.zeros(lm.CONTEXTS), {}
        for x in rest:
            roots[x.w] = x.root
            held[x.u] += x.held
        shared = sum(roots.values()) - model.d0 * len(roots)
        mass = held * model.per + model.back * (shared / model.root_all + model.new)
        assert np.allclose(mass, 1, atol=1e-5)


def test_empty_training(spark, odd_docs):
    model = lm.fit(odd_docs.limit(0))
    rows = lm.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(x.n_known == 0 and x.base_score == 0 for x in rows)
    assert lm.score(odd_docs.limit(0), model).count() == 0


def test_seats_against_enumeration():
    """The numbers of seatings are those that counting partitions gives."""
    s = lm.Seating(0.4, 0.5, np.zeros(lm.CONTEXTS))

    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            yield [*p, 1]
            for i in range(len(p)):
                yield [*p[:i], p[i] + 1, *p[i + 1 :]]

    weight = lambda p: math.prod(math.prod(j - 0.4 for j in range(1, x)) for x in p)
    for c in (2, 4, 7):
        for t in range(1, c + 1):
            assert math.isclose(math.exp(s.log_s[c, t]), sum(weight(p) for p in partitions(c) if len(p) == t), rel_tol=1e-9)
    # beyond EXACT customers the law goes on as it was, but for a constant of the cell
    t, pull = np.arange(20.0, 90.0), np.full(70, -1.0)
    near, far = (s.law(np.full(70, c), t, np.full(70, 3.0), pull) for c in (200.0, 201.0))
    assert np.allclose(near - near[0], far - far[0], atol=0.4)


def test_same_scores_however_dealt(spark):
    r = random.Random(3)
    corpus = [(i, " ".join(f"w{min(int(r.paretovariate(0.6)), 400)}" for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = []
    for partitions, rows in ((1, "10000"), (7, "5")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            dealt = docs.repartition(partitions)
            scored = lm.score(dealt, lm.fit(dealt, head=30)).cache()
            got.append({x.doc_id: x.score for x in scored.collect()})
            one = lm.perplexity(scored).first()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(abs(got[0][i] - got[1][i]) < 1e-6 for i in got[0])
    tokens = 61 * 120
    assert math.isclose(one.perplexity, 10 ** (-sum(got[1].values()) / tokens), rel_tol=1e-9) and one.perplexity < one.base_perplexity


def test_frequent_words_in_the_drivers_memory(spark):
    """The frequent words fill their table without an object for each cell; what is scored from it is what the join gives."""
    import tracemalloc

    n = 20_000
    words = spark.range(n).selectExpr("id * 7919 % 1000003 w", "id + 2 c", "64D root", "transform(sequence(0, 63), x -> cast(x as tinyint)) us", "transform(sequence(0, 63), x -> cast((id + x) % 5 / 10 as float)) held")
    each = np.ones(lm.CONTEXTS)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tracemalloc.start()
    try:
        lm.score(docs, lm.Model(words, 10**9, n, 0.5, each / 2, each / 1e6, 64.0 * n, 1.0, 2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 4 * n * lm.CONTEXTS * 4, most

    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(int(r.paretovariate(0.6)), 400)}" for _ in range(60))) for i in range(60)], "doc_id long, text string")
    model, got = lm.fit(docs.where("doc_id % 3 > 0")), []
    for model.least in (1, 5, 1 << 40):
        got.append({x.doc_id: (x.n_known, x.base_score, x.score) for x in lm.score(docs, model).collect()})
    assert all(np.allclose(one[i], got[-1][i], rtol=1e-6) for one in got for i in range(60))


def plain_tables(counts, u, d, d0, tables, sweeps, r):
    """Mean numbers of tables of one word's cells, by moving one customer at a time between tables that are known one by one."""
    theta, seats = 1.0, [[c] for c in counts]
    everything, total, seen = theta + tables.sum(), np.zeros(len(counts)), 0
    for sweep in range(sweeps):
        for i, c in enumerate(counts):
            own = seats[i]
            for _ in range(c):
                k = r.choices(range(len(own)), own)[0]
                own[k] -= 1
                if not own[k]:
                    del own[k]
                root = sum(map(len, seats))
                new = (theta + d * tables[u[i]]) * max(root - d0, 1e-9) / everything
                if r.random() * (new + c - 1 - d * len(own)) < new:
                    own.append(1)
                else:
                    own[r.choices(range(len(own)), [x - d for x in own])[0]] += 1
        if sweep >= sweeps // 5:
            total += [len(x) for x in seats]
            seen += 1
    return total / seen


def test_seats_as_one_customer_at_a_time():
    """Whole sweeps settle where a plain sampler does, for cells below and above EXACT."""
    import pyarrow as pa

    tables = np.linspace(50, 5000, lm.CONTEXTS)
    for counts, d, d0 in (([20, 100, 3], 0.6, 0.5), ([260, 2, 7], 0.6, 0.5)):
        u = [5, 20, 63]
        want = plain_tables(counts, u, d, d0, tables, 1200 if counts[0] == 20 else 700, random.Random(1))
        n = 300  # words alike, so that few samples give a mean
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([bytes(u)] * n, pa.binary()), pa.array([np.array(counts, "<i8").tobytes()] * n, pa.binary())], names=["w", "us", "ns"])
        t, root = lm.Seating(d, d0, tables).run(lm.Cells(batch), 10, 6, 7)
        got = t.reshape(n, -1).mean(0)
        assert np.allclose(got, want, rtol=0.06), (got, want)
        assert np.allclose(root, t.reshape(n, -1).sum(1))


def test_sweeps_of_a_round_settle():
    """The sweeps that fit() makes by itself end where many more do: rare and frequent words over many contexts, started anew."""
    import inspect

    import pyarrow as pa

    r = np.random.default_rng(5)
    n, cells = 4000, []
    for w in range(n):
        u, c = np.unique(r.integers(0, lm.CONTEXTS, int(2 + r.pareto(0.6) % 4000)), return_counts=True)
        cells.append((w * 1_000_003, u.astype(np.uint8).tobytes(), c.astype("<i8").tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["w", "us", "ns"])
    x = lm.Cells(batch)
    seating = lm.Seating(0.7, 0.7, x.by_context(np.ones(len(x.c))))
    default = inspect.signature(lm.fit).parameters["burn"].default
    got, long = (np.mean([seating.run(x, burn, 0, seed)[0].sum() for seed in range(3)]) for burn in (default, 120))
    assert abs(got / long - 1) < 0.01, (default, got, long)
    # batches are put together, and their order and size change nothing
    lots = list(lm._together(batch.slice(i, 300) for i in range(0, n, 300)))
    assert len(lots) == 1 and lots[0].equals(batch)
    parts = np.concatenate([seating.run(lm.Cells(batch.slice(i, 700)), 3, 2, 7)[0] for i in range(0, n, 700)])
    assert np.allclose(parts, seating.run(x, 3, 2, 7)[0])


def test_words_of_one_text_at_a_time():
    """Encoding holds the words of a text only until they are numbered, so a worker's memory doesn't grow with all words of a part of the corpus."""
    import weakref

    class Words(list):
        pass

    class Pattern:
        seen, most = [], 0

        def findall(self, text):
            words = Words(re.findall(r" ?[a-z]+", text))
            self.seen.append(weakref.ref(words))
            self.most = max(self.most, sum(x() is not None for x in self.seen))
            return words

    vocab = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257})
    pattern, texts = Pattern(), ["ab abc ab"] * 40 + ["", "cab ab"]
    flat, starts = bpe.encode(bpe.Lexicon(vocab), pattern, texts)
    assert [bpe.decode(vocab, flat[a:b].tolist()).decode() for a, b in zip(starts, starts[1:], strict=False)] == texts
    assert pattern.most <= 2
