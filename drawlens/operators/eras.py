"""Changes of a game's rules, seen in its numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.history import History

LEAST_DRAWS, LEAST_KEPT, SPAN, HEAD, GROWTH = 240, 120, 60, 0.3, 6  # fixed values of the detection


def detect(h: History) -> DataFrame:
    """game, kind, cutoff, draws, kept, current_max, prior_max: at most one row for each game.

    The current pool is the largest number of the last span (5 % of the draws, 60 at least). If earlier draws hold a larger one (main or bonus), the pool shrank: the era starts
    after the last such draw, or, where the main pool then grew, at its first larger number. Else, if it exceeds the first 30 % of draws by 6, it grew, and the era starts at
    the first number beyond those. An era needs 120 draws, a history 240. All from minima and maxima over draws: one aggregate each.
    """
    rows = h.draws.select("game", "t", F.element_at("sorted", -1).alias("m"), F.coalesce("special", F.lit(0)).alias("s")).join(h.sizes, "game").where(F.col("draws") >= LEAST_DRAWS)
    span = F.greatest(F.lit(SPAN), F.floor(F.col("draws") * 0.05))
    recent, head = F.col("t") >= F.col("draws") - span, F.col("t") < F.floor(F.col("draws") * HEAD)
    top = lambda c, x: F.max(F.when(c, F.col(x)))
    facts = rows.groupBy("game", "draws").agg(top(recent, "m").alias("current_max"), top(recent, "s").alias("current_special"), top(head, "m").alias("head_max"))
    rows = rows.drop("draws").join(facts, "game")
    above = (F.col("m") > F.col("current_max")) | ((F.col("current_special") > 0) & (F.col("s") > F.col("current_special")))
    cut = rows.groupBy("game", "draws", "current_max", "head_max").agg((F.max(F.when(above, F.col("t"))) + 1).alias("shrink"), F.min(F.when(F.col("m") > F.col("head_max"), F.col("t"))).alias("grow"))
    prior = h.draws.select("game", "t", F.element_at("sorted", -1).alias("m")).join(cut, "game").where(F.col("shrink").isNotNull())
    prior = prior.groupBy("game").agg(F.max(F.when(F.col("t") < F.col("shrink"), F.col("m"))).alias("prior_max"))
    later = h.draws.select("game", "t", F.element_at("sorted", -1).alias("m")).join(prior, "game").where(F.col("m") > F.col("prior_max")).groupBy("game").agg(F.min("t").alias("later"))
    rows = cut.join(prior, "game", "left").join(later, "game", "left")
    grew = F.col("current_max") >= F.col("head_max") + GROWTH
    cutoff = F.when(F.col("shrink").isNotNull(), F.when(F.col("current_max") > F.col("prior_max"), F.greatest("shrink", "later")).otherwise(F.col("shrink"))).when(grew, F.col("grow"))
    rows = rows.withColumn("kind", F.when(F.col("shrink").isNotNull(), "shrink").when(grew, "grow")).withColumn("cutoff", cutoff)
    kept = F.col("draws") - F.col("cutoff")
    return rows.where(F.col("cutoff").isNotNull() & (F.col("cutoff") > 0) & (kept >= LEAST_KEPT)).select("game", "kind", "cutoff", "draws", kept.alias("kept"), "current_max", F.coalesce("prior_max", "head_max").alias("prior_max"))


def scoped(h: History) -> History:
    """The history from each game's cutoff on, renumbered; games without one stay whole."""
    rows = h.draws.join(detect(h).select("game", "cutoff"), "game", "left").withColumn("_from", F.coalesce("cutoff", F.lit(0)))
    rows = rows.where(F.col("t") >= F.col("_from")).withColumn("t", F.col("t") - F.col("_from")).drop("cutoff", "_from")
    return History(rows, h.k, h.d, h.ks)
