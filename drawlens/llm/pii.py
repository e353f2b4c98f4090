"""Personal data in texts: fixed kinds, and contexts that are learned from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.llm import spans
from drawlens.llm.scratch import materialise

EMAIL, IP, CARD, PHONE, CONTEXT = range(5)
KINDS = ["email", "ip", "card", "phone", "context"]

# Fixed patterns. Each starts where a run starts, so that a long run is read once; the sets and repetitions are those of the kinds' definitions.
# No group with a body of variable length is repeated (Java matches those by recursion): a domain runs on to two dots, a dot at its end, or what no domain holds.
EMAIL_AT = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
IP_AT = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_AT = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE_AT = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# A label with its separator, and the whole value that stands behind it; phones and cards hold spaces, other values end there.
LABELLED_AT = rf"""(?<![\p{{L}}_-])[\p{{L}}_-]{{2,}}+\x20?[:=#]\x20{{0,2}}(?:{PHONE_AT}|{CARD_AT}|[^\s"',;:=#]{{5,}}+)"""
LABEL_AT = r"^([\p{L}_-]+\x20?[:=#])\x20{0,2}(.+)$"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.split(F.reverse(digits), "")
    twice = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    n = F.char_length(_digits(found))
    return (
        F.when(kind == IP, F.regexp_like(found, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")))
        .when(kind == CARD, n.between(14, 19) & luhn(_digits(found)))
        .when(kind == PHONE, n.between(10, 15))
        .otherwise(kind == EMAIL)
    )


def confident_labels(edges: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """Labels whose values are mostly personal data: label, score.

    edges: label, value, seed (the value is personal data by its form). A label's score is the mean belief in its distinct values, with one
    unbelieved value added; a value's belief is 1 for a seed, else the chance that at least one of its confident labels is right. Beliefs and
    scores are recomputed `rounds` times. A label needs values whose beliefs sum up to `least_seeds`, as of so many distinct seeds.
    """
    edges = materialise(edges.groupBy("label", "value").agg(F.max("seed").alias("seed")), "labels")
    belief = F.col("seed").cast("double")
    scores = None
    for _ in range(rounds):
        scored = edges
        if scores is not None:
            trusted = scores.where(F.col("score") >= confidence).select("label", "score")
            doubt = edges.join(trusted, "label").groupBy("value").agg(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))).alias("doubt"))
            scored = edges.join(doubt, "value", "left")
            belief = F.when(F.col("seed"), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0)))
        scores = scored.groupBy("label").agg((F.sum(belief) / (F.count(F.lit(1)) + 1)).alias("score"), F.sum(belief).alias("support"))
        scores = scores.where(F.col("support") >= least_seeds - 1e-9)
    return scores.where(F.col("score") >= confidence).select("label", "score")


TRUSTED_AT_ONCE = 1000  # so many labels are a test in the plan; more are joined


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of located() with label (of labelled values, whose start, end and found become the value's), _base (a valid find of a base kind) and _covered (a base find overlaps)."""
    kind = F.col("kind")
    labelled = kind == CONTEXT
    value = F.rtrim(F.regexp_extract("found", LABEL_AT, 2), F.lit(".)]}>!?"))
    rows = rows.withColumn("label", F.when(labelled, F.lower(F.regexp_extract("found", LABEL_AT, 1))))
    rows = rows.withColumn("start", F.when(labelled, F.col("end") - F.char_length(F.regexp_extract("found", LABEL_AT, 2))).otherwise(F.col("start")).cast("int"))
    rows = rows.withColumn("found", F.when(labelled, value).otherwise(F.col("found")))
    rows = rows.withColumn("end", (F.col("start") + F.char_length("found")).cast("int"))
    rows = rows.withColumn("kind", F.when(labelled | _valid(kind, F.col("found")), kind))
    ordered = "partition by _row order by start asc nulls first, kind desc"
    rows = rows.withColumn("_base", F.coalesce(F.col("kind") < CONTEXT, F.lit(False)))
    rows = rows.withColumn("_base_end", F.expr(f"max(case when _base then end end) over ({ordered} rows between unbounded preceding and current row)"))
    rows = rows.withColumn("_base_start", F.expr(f"min(case when _base then start end) over ({ordered} rows between current row and unbounded following)"))
    covered = F.coalesce(F.col("_base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_base_start") < F.col("end"), F.lit(False))
    return rows.withColumn("_covered", covered).drop("_base_end", "_base_start")


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """The columns `keep` of docs (all but the text, if not given) and `spans`: an array of (start, kind, end, found, base).

    Email, ip, card and phone are reported wherever they are found and valid (`base` true); they are the seeds. Labels in front of seeds
    ("contact: ", "ref #") are the lexical patterns; confident_labels() scores them over the whole corpus, counting every value that stands behind them,
    and the values of confident labels that hold a digit or @ are reported as `context` where no base span overlaps.

    Distinct (label, value) pairs are summed before they are joined, so that a label of a third of the rows costs no more than its values. A null or
    empty text has no spans; repeated rows are handled each by itself; an empty table gives an empty result. A column of docs named `spans` is replaced; other names may be any.
    """
    keep = spans.columns_for(docs, text, keep)
    rows = _found(docs, text, keep, rounds, least_seeds, confidence)
    return rows.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], "spans")


def _found(docs: DataFrame, text: str, keep: list[str], rounds: int = 3, least_seeds: int = 3, confidence: float = 0.6) -> DataFrame:
    """find() with the kept columns as one struct, `_kept`."""
    found = [
        lambda t: spans.parts(t, EMAIL, EMAIL_AT, t.contains("@")),
        lambda t: spans.parts(t, IP, IP_AT),
        lambda t: spans.parts(t, CARD, CARD_AT),
        lambda t: spans.parts(t, PHONE, PHONE_AT, t.contains("+")),
        lambda t: spans.parts(t, CONTEXT, LABELLED_AT, t.contains(":") | t.contains("=") | t.contains("#")),
    ]
    # Texts are scanned twice, once for the labels alone, so that what is kept of a document is shuffled once and written nowhere.
    edges = _placed(spans.located(docs, text, found, [])).where(F.col("label").isNotNull()).select("label", F.lower("found").alias("value"), F.col("_covered").alias("seed"))
    trusted = materialise(confident_labels(edges, rounds, least_seeds, confidence), "trusted").withColumnRenamed("label", "_label")
    rows = _placed(spans.located(docs, text, found, keep))
    plain = rows.where(F.col("label").isNull()).withColumn("_trusted", F.lit(None).cast("boolean"))
    known = {r._label for r in trusted.limit(TRUSTED_AT_ONCE + 1).collect()}
    if len(known) <= TRUSTED_AT_ONCE:  # few labels, as is usual: a test, not a join
        rows = rows.withColumn("_trusted", F.col("label").isin(*sorted(known)) if known else F.lit(False))
    else:
        learned = rows.where(F.col("label").isNotNull()).join(trusted.withColumn("_trusted", F.lit(True)), F.col("label") == F.col("_label"), "left").select(*plain.columns)
        rows = plain.unionByName(learned)
    new = F.col("_trusted") & ~F.col("_covered") & F.regexp_like("found", F.lit("[0-9@]"))
    return spans.gathered(rows.withColumn("base", F.when(F.col("_base"), F.lit(True)).when(new, F.lit(False))))


def redact(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with every span found replaced by its kind in angle brackets, <email>; overlapping spans become one. Columns and order as in docs."""
    found = _found(docs, text, docs.columns, **how)
    names, own = F.array(*[F.lit(f"<{k}>") for k in KINDS]), F.col(f"_kept.`{text}`")

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(own, a["at"] + 1, s["start"] - a["at"])
        return F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(gap, F.get(names, s["kind"])))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at")
        )

    done = F.aggregate("spans", F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step)
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(done["out"], ""), F.substring(own, done["at"] + 1, F.char_length(own)))).otherwise(own)
    return found.select(*[new.alias(c) if c == text else F.col(f"_kept.`{c}`").alias(c) for c in docs.columns])
