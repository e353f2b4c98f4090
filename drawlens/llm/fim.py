"""Fill-in-middle: texts are cut at two unit ends and put together in another order."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def automaton():
    """One automaton for all events: characters between which the class (blank or not) changes, value 0, and sentinels, value 1."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in BLANKS:
        out.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(s, 1)
    out.make_automaton()
    return out


def unit_ends(text: str, events) -> tuple[np.ndarray, bool]:
    """Where the units of a text end, in code points, and whether it has a sentinel.

    A unit is a word with the blanks before it, or the blanks at the end. Only events are visited: a gap between two blanks is a word, so it ends a unit; what stands between isn't looked at.
    """
    found = np.array([end * 2 + kind for end, kind in events.iter(text)], np.int64)
    blanks = np.r_[-1, found[found % 2 == 0] // 2]
    ends = blanks[1:][np.diff(blanks) > 1]
    return (np.r_[ends, len(text)] if text else ends), bool((found % 2).any())


def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """For each text its number of units n, whether it has a sentinel, and the ends (in code points) of so many units as the smaller and the larger of first and second modulo n + 1 say."""
    events, out = automaton(), []
    for text, a, b in zip(texts, first, second, strict=True):
        ends, marked = unit_ends(text, events)
        n = len(ends)
        low, high = sorted((int(a) % (n + 1), int(b) % (n + 1)))
        ends = np.r_[0, ends]
        out.append((n, marked, int(ends[low]), int(ends[high])))
    return pd.DataFrame(out, columns=["n", "marked", "low", "high"])


def rearranged(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """docs without the text, with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output.

    `share` per cent of the texts are cut, `spm` per cent of these begin with the suffix; both and the two cuts come from a hash of seed and id, so any row can be made anywhere, alone. Nothing is shuffled; a task holds
    an Arrow batch of texts. An empty text, and one that holds a sentinel, stays plain. A null text counts as empty; a null id counts as the empty string in the hash; equal rows give equal results; an empty table gives an empty
    result; columns of docs that bear a name of the result are replaced.
    """
    made = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in docs.columns if c != text and c not in made]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc].cast("string"), F.lit(""))).cast("binary"), 256)
    base = docs.select(F.struct(*[docs[c] for c in kept]).alias("_kept"), F.coalesce(docs[text], F.lit("")).alias("_text"), digest.alias("_digest"))
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    cut = F.pandas_udf(cuts, "n long, marked boolean, low int, high int")
    rows = base.withColumn("_cut", cut("_text", h[0], h[1]))
    plain = (F.col("_text") == "") | F.col("_cut.marked") | (h[2] % 100 >= share)
    rows = rows.withColumn("_form", F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"))
    low, high, t = F.col("_cut.low"), F.col("_cut.high"), F.col("_text")
    prefix, middle, suffix = F.substring(t, F.lit(1), low), F.substring(t, low + 1, high - low), F.substring(t, high + 1, F.char_length(t))
    form = F.col("_form")
    output = F.when(form == "plain", t).when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    of = lambda c: F.when(form != "plain", c)
    return rows.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], F.col("_cut.n").alias("n"), form.alias("form"), of(low.cast("long")).alias("prefix_chars"), of((high - low).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The sentinels are the only ones there, as texts that hold any stay plain and no sentinel can arise where pieces meet."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
