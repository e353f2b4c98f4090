"""Secrets in texts, and the linking of multipart credentials."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlens.llm import spans

ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT = range(6)
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]

# Fixed patterns. Runs are maximal, so that asking for their least length inside the pattern finds the same runs.
ASSIGN_AT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_AT = r"AKIA[A-Z0-9]{16,}"
HEX_AT = r"[0-9a-f]{24,}"
# Weak identifiers: upper-case runs of any length, mixed runs shorter than a secret, and UUIDs. Weak secrets and endpoints have no greatest length.
WEAK_ID_AT = (
    r"(?<![A-Za-z0-9-])(?:(?=[A-Z]*[0-9])[A-Z0-9]{16,}+|(?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,31}|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})(?![A-Za-z0-9-])"
)
WEAK_SECRET_AT = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT_AT = r"""(?:https?|wss?|ftp|jdbc:[a-z]+|amqps?|redis|mongodb)://[^\s"'<>]{4,}+"""


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = 200) -> DataFrame:
    """The columns `keep` of docs (all but the text, if not given) and `spans`: an array of (start, kind, end, found, base).

    Kinds assign, access and hex are reported wherever they are found (`base` true). Identifiers, secrets and endpoints of weaker looks are
    reported only with their complement, at most `scope` code points away (from the end of the one to the start of the other) in the same document: an
    identifier with a secret, a secret with an identifier, an endpoint with both. Strong finds count as complements: access as an identifier, assign and
    hex as secrets. A weak find that overlaps a strong one is the same text again and isn't reported.

    The interval join is made of sorted neighbours: if any complement lies within the scope, so does the one that ends last of those that start before,
    or the first that starts after; no pairs are built. Rows of one document meet in one task, whose sort spills; a null or empty text has no spans; repeated rows are
    handled each by itself; an empty table gives an empty result. A column of docs named `spans` is replaced; other names may be any.
    """
    keep = spans.columns_for(docs, text, keep)
    found = [
        lambda t: spans.parts(t, ASSIGN, ASSIGN_AT),
        lambda t: spans.parts(t, ACCESS, ACCESS_AT, t.contains("AKIA")),
        lambda t: spans.parts(t, HEX, HEX_AT),
        lambda t: spans.parts(t, WEAK_ID, WEAK_ID_AT),
        lambda t: spans.parts(t, WEAK_SECRET, WEAK_SECRET_AT),
        lambda t: spans.parts(t, ENDPOINT, ENDPOINT_AT, t.contains("://")),
    ]
    rows = spans.located(docs, text, found, keep)
    kind, start, end = F.col("kind"), F.col("start"), F.col("end")
    short = (kind == ASSIGN) & (F.char_length(F.regexp_extract("found", ASSIGN_AT, 1)) < 6)
    rows = rows.withColumn("kind", F.when(short, None).otherwise(kind))
    kind = F.col("kind")
    strong = kind <= HEX
    before = Window.partitionBy("_row").orderBy(F.col("start").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy(F.col("start").asc_nulls_first(), "kind").rowsBetween(0, Window.unboundedFollowing)
    covered = (F.max(F.when(strong, end)).over(before) > start) | (F.min(F.when(strong, start)).over(after) < end)
    rows = rows.withColumn("kind", F.when(strong | ~F.coalesce(covered, F.lit(False)), kind))

    def near(which):
        earlier, later = F.max(F.when(which, end)).over(before), F.min(F.when(which, start)).over(after)
        return F.coalesce(start - earlier <= scope, F.lit(False)) | F.coalesce(later - end <= scope, F.lit(False))

    rows = rows.withColumn("_id", near(kind.isin(ACCESS, WEAK_ID))).withColumn("_secret", near(kind.isin(ASSIGN, HEX, WEAK_SECRET)))
    linked = F.when(kind == WEAK_ID, F.col("_secret")).when(kind == WEAK_SECRET, F.col("_id")).when(kind == ENDPOINT, F.col("_id") & F.col("_secret"))
    found_spans = spans.gathered(rows.withColumn("base", F.when(strong, F.lit(True)).when(linked, F.lit(False))))
    return found_spans.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], "spans")
