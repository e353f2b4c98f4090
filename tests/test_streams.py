"""Learning on a stream, and what has been seen, against the batch."""

import datetime

from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.history import History
from drawlens.operators import describe, learn, signals
from drawlens.sources import generated
from drawlens.streaming import growing, state


def test_streamed_regression_equals_the_fold(spark, tmp_path):
    keys = ["freqAll", "repeat", "window10"]
    h = generated.planted(spark, 70)
    h = History(cut(h.draws), h.k, h.d, h.ks)
    rows = cut(signals.normalised(signals.raw(h, h.draws.where("t >= 30").select("game", "t", "dow"), keys), keys).select("game", "t", "n", "hit", *keys))
    want = {(r.t, r.n): r.logit for r in learn.gradient_scores(h, rows, keys).collect()}
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for lo, hi in ((30, 45), (40, 55), (55, 70)):  # draws 40 to 44 come twice
        rows.where(F.col("t").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        state.scored(stream, h.k, keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) == 40 * h.k
    assert all(abs(want[r.t, r.n] - r.logit) < 1e-9 for r in got)


def test_seen_draws_are_stored(spark, tmp_path):
    table = str(tmp_path / "seen")
    day = datetime.date(2024, 1, 1)
    draws = spark.createDataFrame([(g, day + datetime.timedelta(i), i) for g in "ab" for i in range(5)], "game string, date date, t long")
    assert growing.unseen(draws, table).count() == 10
    growing.mark_seen(draws.where("game = 'a' and t < 3"), table)
    assert sorted((r.game, r.t) for r in growing.unseen(draws, table).collect()) == [("a", 3), ("a", 4), *[("b", i) for i in range(5)]]
    growing.mark_seen(draws.where("t < 2"), table)  # an older view takes nothing back
    assert sorted((r.game, r.t) for r in growing.unseen(draws, table).collect()) == [("a", 3), ("a", 4), ("b", 2), ("b", 3), ("b", 4)]


def test_hazard_from_stretches_equals_the_grid(spark, monkeypatch):
    monkeypatch.setattr(describe, "BLOCK", 32)
    h = generated.fair(spark, 150, k=40, d=3, games=2)
    h = History(cut(h.draws), 45, 3, 0)  # 41 to 45 are never drawn
    for most in (12, 199):
        seen, want = {}, {}
        for r in h.draws.orderBy("game", "t").collect():
            for n in range(1, 46):
                gap = min(most, r.t - seen[r.game, n] if (r.game, n) in seen else r.t)
                e, x = want.get((r.game, gap), (0, 0))
                want[r.game, gap] = (e + 1, x + (n in r.sorted))
            for n in r.sorted:
                seen[r.game, n] = r.t
        assert {(r.game, r.gap): (r.exposures, r.hits) for r in describe.hazard(h, most).collect()} == want
