"""Portfolios: tickets dealt one after the other so that together they cover a chosen count of numbers, and what they are worth."""

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlens.checkpoints import cut
from drawlens.functions.shapes import total
from drawlens.history import History
from drawlens.operators import combinations, constraints
from drawlens.operators.money import TIERS

# Candidates for a ticket; what an exact count may walk; draws of a simulation.
TRIES, MOST_SUBSETS, MOST_COVER, MOST_TICKETS, TRIALS = 1200, 3_000_000, 62, 16, 20_000


def half_up(x: float) -> int:
    """x (not negative) to the nearest whole number, halves upward."""
    return int(x + 0.5)


def fresh_numbers(count: int, d: int, k: int, spread: float) -> list[int]:
    """How many numbers that no ticket before it has each of `count` tickets brings: together from d (spread 0: always the same numbers) to as many as fit (spread 1)."""
    budget = half_up(d + spread * (min(k, count * d) - d)) - d
    return [d] + [half_up(budget * i / (count - 1)) - half_up(budget * (i - 1) / (count - 1)) for i in range(1, count)]


def chance_of(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts: any row can be made anywhere, alone."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shapes_of(h: History, tail: int = constraints.TAILS[1]) -> DataFrame:
    """game, lo, hi, sum_lo, sum_hi: the bands that places keep to at the tail of 0.2 %, and the band of sums at `tail` (parts of bands.UNIT)."""
    at = constraints.position_bands(h).groupBy("game").agg(F.array_sort(F.collect_list(F.struct("position", "lo", "hi"))).alias("x"))
    sums = constraints.bands.whole(constraints.long(constraints.measured(h, context=False)).where("feature = 'sum'"), h.k, h.d, {"sum": tail})
    return at.select("game", F.transform("x", lambda p: p["lo"]).alias("lo"), F.transform("x", lambda p: p["hi"]).alias("hi")).join(sums.select("game", "sum_lo", "sum_hi"), "game")


def weighted(scores: DataFrame) -> DataFrame:
    """game, numbers: an array of (n, score, weight) in order of n. The weight of a number is its score, if all are positive, else a mild exponential of it."""
    own = Window.partitionBy("game")
    low, high = F.min("score").over(own), F.max("score").over(own)
    weight = F.when(low > 0, F.col("score")).otherwise(F.exp((F.col("score") - high) / F.greatest(high - low, F.lit(1e-9))))
    return scores.select("game", "n", "score", weight.alias("weight")).groupBy("game").agg(F.array_sort(F.collect_list(F.struct("n", "score", "weight"))).alias("numbers"))


def pick(state: DataFrame, d: int, fresh: int, seed: int, slot: int, best: bool, tries: int = TRIES, accept: Column | None = None, barred: DataFrame | None = None) -> DataFrame:
    """game, ticket: the next ticket of each game. state: game, numbers (of weighted()), used (numbers of the tickets before), lo, hi, sum_lo, sum_hi (null: any shape). barred: game, sorted, combinations never to deal; what of it equals a candidate is looked up, so no row holds all of them.

    A candidate takes `fresh` numbers that aren't used and fills up with used ones, as far as there are any, each by weight without replacement: those with the least -ln(u) / weight. The first candidate of the right shape that isn't barred and that `accept` (a test of `c`) lets
    pass is dealt; if none is, the first on flat weights; else the one of the right shape with the highest score; else the best numbers as they are. `best`: the best numbers, if they may be dealt, else the acceptable candidate with the highest score.
    """
    rows = state.withColumn("free", F.filter("numbers", lambda x: ~F.array_contains("used", x["n"]))).withColumn("held", F.filter("numbers", lambda x: F.array_contains("used", x["n"])))
    want = F.least(F.lit(d), F.lit(max(0, fresh)), F.size("free"))
    again = F.least(d - want, F.size("held"))
    rows = rows.withColumn("fresh", d - again).withColumn("again", again)
    first = lambda part, count: F.transform(F.slice(F.array_sort(F.transform(part, lambda x: F.struct((-x["score"]).alias("k"), x["n"].alias("n")))), F.lit(1), count), lambda x: x["n"])
    rows = rows.withColumn("greedy", F.array_sort(F.concat(first(F.col("free"), F.col("fresh")), first(F.col("held"), F.col("again")))))
    tried = rows.withColumn("flat", F.explode(F.array(F.lit(0), F.lit(1)) if not best else F.array(F.lit(0)))).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))

    def drawn(part: str, count: str) -> Column:
        key = lambda x: -F.log(chance_of(F.lit(seed), F.col("game"), F.lit(slot), F.col("flat"), F.col("try"), x["n"])) / F.when(F.col("flat") == 1, 1.0).otherwise(x["weight"])
        return F.transform(F.slice(F.array_sort(F.transform(part, lambda x: F.struct(key(x).alias("k"), x["n"].alias("n")))), F.lit(1), F.col(count)), lambda x: x["n"])

    tried = tried.withColumn("c", F.array_sort(F.concat(drawn("free", "fresh"), drawn("held", "again")))).select("game", "flat", "try", "c", "greedy", "numbers", "lo", "hi", "sum_lo", "sum_hi")
    alone = rows.select("game", F.lit(2).alias("flat"), F.lit(0).alias("try"), F.col("greedy").alias("c"), "greedy", "numbers", "lo", "hi", "sum_lo", "sum_hi")
    tried = cut(tried.unionByName(alone))
    within = F.forall(F.arrays_zip("c", "lo", "hi"), lambda x: (x["c"] >= x["lo"]) & (x["c"] <= x["hi"])) & total(F.col("c")).between(F.col("sum_lo"), F.col("sum_hi"))
    allowed = F.lit(True) if accept is None else accept
    if barred is not None:
        asked = F.broadcast(tried.select("game", F.col("c").alias("sorted")).distinct())  # 2 * tries + 1 a game at most
        known = barred.select("game", "sorted").join(asked, ["game", "sorted"], "leftsemi").distinct().select("game", F.col("sorted").alias("c"), F.lit(True).alias("known"))
        tried = tried.join(F.broadcast(known), ["game", "c"], "left")
        allowed = allowed & F.col("known").isNull()
    score = F.aggregate(F.filter("numbers", lambda x: F.array_contains("c", x["n"])), F.lit(0.0), lambda a, x: a + x["score"])
    tried = tried.select("game", "flat", "try", "c", "greedy", (F.col("lo").isNull() | within).alias("shaped"), F.coalesce(allowed, F.lit(True)).alias("allowed"), F.round(score, 12).alias("score"))
    sampled = F.col("flat") < 2
    good = F.col("shaped") & F.col("allowed")
    order = F.struct("flat", "try")
    dealt = F.min_by("c", F.when(sampled & good, order))
    top = F.min_by("c", F.when(sampled & good, F.struct(-F.col("score"), order)))
    fallback = F.min_by("c", F.when(sampled & F.col("shaped"), F.struct(-F.col("score"), order)))
    legal = F.max_by("c", F.when((F.col("flat") == 2) & good, F.lit(1)))
    ticket = F.coalesce(legal, top, F.max("greedy")) if best else F.coalesce(dealt, fallback, F.max("greedy"))
    return tried.groupBy("game").agg(ticket.alias("ticket"))


def dealt_specials(specials: DataFrame, h: History, seed: int) -> DataFrame:
    """game, ranked, dealt: bonus numbers in order of rank (those given, then the rest of the pool), and dealt without replacement by their chances. specials: game, place, n, probability; the rest share what the given ones leave."""
    pool = specials.select("game").distinct().select("game", F.explode(F.sequence(F.lit(1), F.lit(h.ks))).alias("n"))
    rows = pool.join(specials.select("game", "n", "place", "probability"), ["game", "n"], "left")
    known = F.col("probability").between(1e-12, 1 - 1e-12)
    own = Window.partitionBy("game")
    rest = F.greatest(F.lit(1e-9), 1 - F.sum(F.when(known, F.col("probability")).otherwise(0.0)).over(own)) / F.greatest(F.lit(1), F.sum((~F.coalesce(known, F.lit(False))).cast("int")).over(own))
    rows = rows.withColumn("w", F.when(known, F.col("probability")).otherwise(rest)).withColumn("k", -F.log(chance_of(F.lit(seed), F.col("game"), F.lit("bonus"), F.col("n"))) / F.col("w"))
    listed = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col("n")))), lambda x: x["n"])
    return rows.groupBy("game").agg(listed(F.coalesce("place", F.lit(h.ks + 1)).alias("p")).alias("ranked"), listed(F.col("k")).alias("dealt"))


def built(scores: DataFrame, specials: DataFrame, h: History, count: int = 5, spread: float = 1.0, hold: DataFrame | None = None, shape: DataFrame | None = None, barred: DataFrame | None = None, accept: Column | None = None, seed: int = 1, tries: int = TRIES) -> DataFrame:
    """game, kind, ticket, numbers, special: for each game of scores (game, n, score) `count` tickets of each kind: portfolio, concentrated (the one best ticket again and again) and quick (any numbers).

    A portfolio has held tickets first (game, ticket, numbers, special), then deals the others in turn, each with as many new numbers as fresh_numbers() says, so that spread, 0 to 1, sets how many numbers they cover. Bonus numbers are dealt by the chances of specials (game, place, n, probability), without those
    that are held. shape: shapes_of(); barred: game, sorted, combinations never to deal; accept: a test of an ascending array `c`. There is one round for each ticket; all games take it together.
    """
    spark = h.draws.sparkSession
    base = weighted(scores)
    base = base.join(shape, "game", "left") if shape is not None else base.withColumns({"lo": F.lit(None).cast("array<int>"), "hi": F.lit(None).cast("array<int>"), "sum_lo": F.lit(None).cast("int"), "sum_hi": F.lit(None).cast("int")})
    base = cut(base)
    held = (hold if hold is not None else spark.createDataFrame([], "game string, ticket int, numbers array<int>, special int")).withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy("ticket"))).where(F.col("r") <= count)
    kept = held.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("r", "numbers", "special"))).alias("held"))
    state = base.join(kept, "game", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<r:int,numbers:array<int>,special:int>>")))
    state = cut(state.withColumn("tickets", F.transform("held", lambda x: F.array_sort(x["numbers"]))).withColumn("used", F.array_distinct(F.flatten("tickets"))))
    fresh = fresh_numbers(count, h.d, h.k, spread)
    for slot in range(count):
        ticket = pick(state.where(F.size("tickets") == slot), h.d, fresh[slot], seed, slot, spread == 0, tries, accept, barred)
        state = state.join(ticket, "game", "left").withColumn("tickets", F.when(F.col("ticket").isNotNull(), F.array_append("tickets", F.col("ticket"))).otherwise(F.col("tickets")))
        state = cut(state.withColumn("used", F.array_distinct(F.flatten("tickets"))).drop("ticket"))
    top = pick(base.withColumn("used", F.array().cast("array<int>")), h.d, h.d, seed, count, True, tries, accept, barred)
    bonus = dealt_specials(specials, h, seed) if h.ks else base.select("game").withColumns({"ranked": F.array().cast("array<int>"), "dealt": F.array().cast("array<int>")})
    rows = state.select("game", "tickets", "held").join(bonus, "game", "left").join(top, "game")
    taken = F.transform("held", lambda x: x["special"])
    free = F.filter(F.slice("dealt", 1, count), lambda x: ~F.array_contains(F.array_compact(taken), x))
    more = F.filter("ranked", lambda x: ~F.array_contains(F.array_compact(taken), x) & ~F.array_contains(free, x))
    pool = F.when(F.size(free) >= count - F.size("held"), free).otherwise(F.slice(F.concat(free, more), F.lit(1), F.greatest(F.size(free), count - F.size("held"))))
    rows = rows.withColumn("pool", F.when(F.size(pool) > 0, pool).otherwise(F.col("dealt"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(count))))
    own = F.when(F.col("at") <= F.size("held"), F.get(taken, F.col("at") - 1))
    dealt = F.get("ranked", F.lit(0)) if spread == 0 else F.get("pool", ((F.col("at") - 1 - F.size("held")) % F.greatest(F.size("pool"), F.lit(1))).cast("int"))
    special = F.when(F.col("at") <= F.size("held"), own).otherwise(dealt) if h.ks else F.lit(None).cast("int")
    quick = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(h.k)), lambda n: F.struct(chance_of(F.lit(seed), F.col("game"), F.lit("quick"), F.col("at"), n).alias("k"), n.cast("int").alias("n")))), 1, h.d), lambda x: x["n"]))
    luck = F.floor(chance_of(F.lit(seed), F.col("game"), F.lit("quick"), F.col("at")) * h.ks).cast("int") + 1 if h.ks else F.lit(None).cast("int")
    kinds = F.array(
        F.struct(F.lit("portfolio").alias("kind"), F.get("tickets", F.col("at") - 1).alias("numbers"), special.alias("special")), F.struct(F.lit("concentrated").alias("kind"), F.col("ticket").alias("numbers"), (F.get("ranked", F.lit(0)) if h.ks else F.lit(None).cast("int")).alias("special")),
        F.struct(F.lit("quick").alias("kind"), quick.alias("numbers"), luck.alias("special")),
    )
    return rows.select("game", F.col("at").alias("ticket"), F.inline(kinds)).select("game", "kind", "ticket", "numbers", "special")


def simulated(sets: DataFrame, k: int, d: int, ks: int, trials: int = TRIALS, seed: int = 1, tiers: list[tuple] = TIERS) -> DataFrame:
    """sets (game, kind, held: an array of numbers and special) with tickets, covered, any_prize, three, four, best_match and exact = false: over `trials` draws that are made by hash, each in its own row."""
    ids = sets.sparkSession.range(trials)
    key = lambda n: F.struct(chance_of(F.lit(seed), F.lit("trial"), F.col("id"), n).alias("k"), n.cast("int").alias("n"))
    draws = ids.select("id", F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(k)), key)), 1, d), lambda x: x["n"]).alias("drawn"), (F.floor(chance_of(F.lit(seed), F.lit("bonus"), F.col("id")) * max(ks, 1)).cast("int") + 1).alias("bonus"))
    paying = {(m, b) for m, b, prize in tiers if prize > 0}
    met = cut(draws).join(F.broadcast(sets), F.lit(True)).withColumn("x", F.transform("held", lambda t: F.struct(F.size(F.array_intersect(t["numbers"], "drawn")).alias("m"), F.coalesce((t["special"] == F.col("bonus")) & F.lit(ks > 0), F.lit(False)).alias("b"))))
    wins = lambda x: F.lit(False) if not paying else F.struct(x["m"], x["b"]).isin([F.struct(F.lit(m), F.lit(b)) for m, b in sorted(paying)])
    paid = F.exists("x", lambda x: ((x["m"] == d) & (x["b"] | F.lit(ks == 0))) | wins(x))
    best = F.array_max(F.transform("x", lambda x: x["m"]))
    return met.groupBy("game", "kind").agg(
        F.max(F.size("held")).alias("tickets"), F.max(F.size(F.array_distinct(F.flatten(F.transform("held", lambda t: t["numbers"]))))).alias("covered"), F.avg(paid.cast("double")).alias("any_prize"), F.avg((best >= 3).cast("double")).alias("three"), F.avg((best >= 4).cast("double")).alias("four"),
        F.avg(best.cast("double")).alias("best_match"),
    ).withColumn("exact", F.lit(False))


def scored(tickets: DataFrame, k: int, d: int, ks: int, trials: int = TRIALS, seed: int = 1, tiers: list[tuple] = TIERS) -> DataFrame:
    """game, kind, tickets, covered, any_prize, three, four, best_match, exact: what each set of tickets (game, kind, numbers, special) does at one draw; counted where the choices of covered numbers are few enough, else simulated."""
    sets = cut(tickets.groupBy("game", "kind").agg(F.collect_list(F.struct(F.array_sort("numbers").alias("numbers"), "special")).alias("held")))
    cover = F.size(F.array_distinct(F.flatten(F.transform("held", lambda t: t["numbers"]))))
    walked = {u: sum(comb(u, j) for j in range(d + 1)) for u in range(k + 1)}
    most = max(u for u, n in walked.items() if n <= MOST_SUBSETS and u <= MOST_COVER)
    few = (cover <= most) & (F.size("held") <= MOST_TICKETS)
    exact = combinations.portfolio_stats(sets.where(few).select("game", "kind", F.inline("held")), k, d, ks, tiers, by=["game", "kind"])
    exact = exact.select("game", "kind", "tickets", "covered", "any_prize", "three", "four", "best_match", F.lit(True).alias("exact"))
    return exact.unionByName(simulated(sets.where(~few), k, d, ks, trials, seed, tiers))
