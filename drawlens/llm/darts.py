"""DartMinHash, and near-duplicate classes of documents.

Darts are hashed points over the region of an element: its weight on one axis, a rank on the other. Where a dart lies depends on the element alone, so two sets
that share an element share the darts below both of their weights. Each dart belongs to a coordinate of the signature, and each coordinate keeps its dart of the
lowest rank: two sets agree in a coordinate with the chance of their weighted Jaccard similarity. Only about k ln k + 2 k darts are thrown for a set, however
many elements it has.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlens.llm.lm import Tokens, _mixed, slices
from drawlens.llm.scratch import drop, materialise

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
SLICE = 512 << 10  # bytes of text that a worker takes at once; it keeps about 80 times as much
# The chance that a unit of area holds at most 0, 1, 2 ... darts.
POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 13)])])


def signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """For each of n sets k numbers, the darts kept; 0 throughout for a set without elements.

    of: the set of each entry, ascending; element: its hash; weight: above 0. The region of an element is cut into strips of weight, [0, 1), [1, 2), [2, 4), [4, 8) ..., and
    every strip into cells of area 1, which hold a Poisson(1) number of darts. Ranks are read up to a limit that gives a set the wanted number of
    darts; the limit is doubled for sets with coordinates that got none.
    """
    best = np.full(n * k, np.iinfo(np.uint64).max)
    names = np.zeros(n * k, np.uint64)
    total = np.bincount(of, weight, n)
    want = k * np.log(k) + 2 * k
    limit = np.where(total > 0, want / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        here = np.isin(of, todo) if len(todo) < n else np.ones(len(of), bool)
        for strip in range(int(np.ceil(np.log2(max(weight.max(), 1)))) + 1):
            low, high = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0**strip)
            rows = np.flatnonzero(here & (weight > low))
            if len(rows):
                _throw(best, names, of[rows], element[rows], weight[rows], limit[of[rows]], strip, low, high - low, k, seed)
        open_ = (best.reshape(n, k)[todo] == np.iinfo(np.uint64).max).any(1)
        todo = todo[open_]
        limit[todo] *= 2
    return names.reshape(n, k)


def _throw(best, names, of, element, weight, limit, strip, low, width, k, seed) -> None:
    """Throws the darts of one strip of weights below the limits of rank."""
    cells = np.ceil(limit * width).astype(np.int64)  # a cell's height is 1 / width
    for a in range(0, len(of), max(1, 2_000_000 // max(1, int(cells.max())))):
        b = slice(a, a + max(1, 2_000_000 // max(1, int(cells.max()))))
        c = cells[b]
        row = np.repeat(np.arange(a, a + len(c)), c)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        h = _mixed(element[row] ^ _mixed(cell.astype(np.uint64) * GOLD + U(strip * 1_000_003 + seed * 7_919)))
        darts = np.searchsorted(POISSON, (h >> U(11)).astype(float) * 2.0**-53)
        at = np.repeat(np.arange(len(row)), darts)
        dart = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        d = _mixed(h[at] + (dart.astype(np.uint64) + U(1)) * GOLD)
        row, cell = row[at], cell[at]
        e = _mixed(d + GOLD)
        rank = (cell + (e >> U(11)).astype(float) * 2.0**-53) / width
        height = low + width * ((d >> U(40)).astype(float) * 2.0**-24)
        inside = (rank < limit[row]) & (height < weight[row])
        row, rank, d = row[inside], rank[inside], d[inside]
        slot = of[row] * k + ((d & U(0xFFFFFFFF)) % U(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, rank, d = slot[order], rank[order], d[order]
        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
        slot, key, d = slot[first], rank[first].view(np.uint64), d[first]  # the bits of floats above 0 are in their order
        better = key < best[slot]
        best[slot[better]], names[slot[better]] = key[better], d[better]


def shingles(h: np.ndarray, text: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: the text's number, a hash, and the weight (how often the text has it), in order of the first two. A text of fewer words is one shingle; one of none has none."""
    size = np.bincount(text, minlength=n)
    start = np.cumsum(size) - size
    mixed = np.zeros(len(h), np.uint64)
    span = np.minimum(size[text], words)
    for i in range(words):
        at = np.minimum(np.arange(len(h)) + i, max(len(h) - 1, 0))
        mixed = np.where(i < span, _mixed(mixed * U(3) + h[at] + U(i)), mixed)
    keep = np.arange(len(h)) - start[text] <= size[text] - span
    order = np.lexsort((mixed[keep], text[keep]))
    t, m = text[keep][order], mixed[keep][order]
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (m[1:] != m[:-1])]) if len(t) else np.zeros(0, np.int64)
    return t[new], m[new], np.diff(np.r_[new, len(t)]).astype(float)


def _units(t: np.ndarray, m: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shingles as sets: a shingle of weight k becomes k elements, so that plain set operations give weighted similarities."""
    k = weight.astype(np.int64)
    row = np.repeat(np.arange(len(m)), k)
    again = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    return t[row], np.where(again > 0, _mixed(m[row] + again.astype(np.uint64) * GOLD), m[row])


def _words(tokens: Tokens, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, the text of each, and each text's node: a hash of its words in order, the same for copies."""
    n = len(ends)
    h, of = tokens.read(data, ends)
    last = np.r_[of[1:] != of[:-1], True]
    h, of = h[~last], of[~last]
    size = np.bincount(of, minlength=n)
    place = np.arange(len(h)) - (np.cumsum(size) - size)[of]
    node = np.zeros(n, np.uint64)
    np.add.at(node, of, _mixed(h ^ _mixed(place.astype(np.uint64) + GOLD)))
    return h, of, _mixed(node + size.astype(np.uint64)).view(np.int64)


def _first(node: np.ndarray) -> np.ndarray:
    """Whether each is the first of its kind."""
    first = np.zeros(len(node), bool)
    first[np.unique(node, return_index=True)[1]] = True
    return first


def contents(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: of documents (key, at: a hash of the text as it is, node), and of contents (node, size, bands) for texts with words; size is the sum of the weights. A content is written once for each slice of a batch that holds it."""
    k = bands * rows
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("at", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for lo, hi, data, ends in slices(batch.column(2), SLICE):
                n = hi - lo
                h, of, node = _words(tokens, data, ends)
                own = _first(node)[of]
                t, m, weight = shingles(h[own], of[own], n, words)
                sig = signatures(t, m, weight, n, k)
                folded = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1).astype(np.uint64) * GOLD
                for r in range(rows):
                    folded = _mixed(folded + sig.reshape(n, bands, rows)[:, :, r])
                sizes = np.bincount(t, weight, n)
                has = sizes > 0
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, bands, 0))].astype(np.int32)), pa.array(folded[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(node), pa.array(sizes.astype(np.int32)), lists], names=schema.names)

    given = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = materialise(given.mapInArrow(run, schema), "contents")
    return made.select("key", "at", "node"), made.where(F.size("bands") > 0).select("node", "size", "bands")


def sets_of(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """node, shingles: the whole weighted sets of the contents in wanted (key, at: of one document of each), read from the texts again, so that no other set is ever written or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for lo, hi, data, ends in slices(batch.column(0), SLICE):
                h, of, node = _words(tokens, data, ends)
                first = _first(node)
                t, m = _units(*shingles(h[first[of]], of[first[of]], hi - lo, words))
                counts = np.bincount(t, minlength=hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(m.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "shingles"]).filter(pa.array(counts > 0))

    here = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_at"), F.col(text).alias("text"))
    found = here.join(wanted, here["_key"].eqNullSafe(wanted["key"]) & (here["_at"] == wanted["at"]), "leftsemi").select("text").mapInArrow(run, "node long, shingles array<long>")
    return materialise(found.dropDuplicates(["node"]), "sets")


def sketches(sets: DataFrame) -> DataFrame:
    """node, bits: of each set one bit of each of SKETCH coordinates. Two sets differ in half as large a part of the bits as they are apart; five deviations more are allowed, which a pair fails with a chance of 3e-7."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                n, lists = some.num_rows, some.column(1)
                element = lists.flatten().to_numpy().view(np.uint64)
                of = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                sig = signatures(of, element, np.ones(len(of)), n, SKETCH, seed=2)
                bits = np.packbits((sig >> U(36) & U(1)).astype(np.uint8), axis=1).view(np.int64)
                rows = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * (SKETCH // 64)).astype(np.int32)), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column(0), rows], names=["node", "bits"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, bits array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): node, comp, the smallest node of each connected component, by large and small stars in turn until only stars are left.

    Nodes without edges aren't in the result.
    """
    edges = _starred(edges)
    return edges.union(edges.select("comp", "comp").distinct().toDF("node", "comp"))


def _starred(edges: DataFrame) -> DataFrame:
    """components() without the smallest nodes themselves: a written table, read as it is wherever parts are asked for.

    A node's neighbours are never gathered: each star is a minimum by node, joined back. Edges that are stars already, as those of an earlier result, take no turn.
    """
    down = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]

    def stars(e: DataFrame) -> bool:
        """Whether each node is either the smallest of its neighbours or has a single one, which is such a smallest."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below > 0 and above > 0)").isEmpty()

    files = _files(edges.count())
    edges = materialise(edges.select(down).where("a != b").distinct(), "edges", files)
    while not stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
        old, edges = edges, materialise(small.select(down).distinct(), "edges", files)
        drop(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _files(rows: int) -> int:
    """Files for a table with a few numbers for each of so many rows."""
    return 1 + rows // 200_000


def _gathered(df: DataFrame, name: str, files: int) -> DataFrame:
    """materialise() in so many files, for what many tasks find little of: each task would write a file of its own, however small, and Hadoop's local file system forks the executor twice for each."""
    return materialise(df.repartition(files), name)


SKETCH = 2048  # coordinates of which the last contents to be compared keep one bit each
FEW = 128  # an element that so many of the last contents have, at most, brings them together
PIVOTS = 3  # rounds in which the rest of every band is compared with one of its members


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """One row for each document: key, class_id (the smallest key of its class) and class_size.

    Documents whose lower-cased words are the same are copies. Two contents are linked if the weighted Jaccard similarity of their shingles of `words` words (a shingle
    weighs as often as the text has it) is at least `similarity`; classes are the connected parts. At a similarity of 0.8 two contents share no band of the signature with a chance of 7e-5; those that share
    one are compared by their whole sets (but for the sketches' 3e-7, see _parts()). A null or empty text has no words, and all such are copies of each other. A document with a null key gets its class as any other; the key of a class of such alone is
    null. An empty table gives an empty result.
    """
    members, nodes = _parts(docs, key, text, similarity, words, bands, rows)
    heads = nodes.groupBy("comp").agg(F.min("one.key").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialise(nodes.join(heads, "comp").select("node", "class_id", "class_size"), "classes")
    return members.join(named, "node").select(F.col("key").alias(key), "class_id", "class_size")


def _parts(docs: DataFrame, key: str, text: str, similarity: float, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """members (key, at, node) of the documents, and nodes: one row for each content with comp (its part), one (its document of the least key, nulls last) and copies.

    Every content meets the lowest of its bands (stars, never all pairs of a band). Then only bands whose contents are in different parts are of interest: in
    each round all their contents meet one, first the one with the least of its own. Shingles that no other content of these bands has can't be common to a pair, which
    bounds the similarities that a content can have: those of whom nothing near enough can exist leave, and with them nearly all of a large group of copies that are
    too far from each other. What then is still in one band and in different parts meets by elements that few have (FEW at most, so the pairs are linear in the elements): a content
    of which s elements are needed for a link holds more than it can lack among them, so no link is lost, and pairs whose common rare elements are too few end there. Only contents made of
    frequent elements, from which that can't be told, are compared pair by pair, by long sketches first.
    """
    members, every = contents(docs, key, text, words, bands, rows)
    one = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "at")).alias("one")
    nodes = materialise(members.groupBy("node").agg(one, F.count(F.lit(1)).alias("copies")), "nodes")
    files = _files(nodes.count())
    banded = materialise(every.dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("band")), "bands")
    lowest = banded.groupBy("band").agg(F.min(F.struct("node", "size")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    fits = lambda x, y: F.least(x, y) >= F.lit(similarity - 1e-9) * F.greatest(x, y)
    stars = banded.join(lowest, "band").where((F.col("node") != F.col("low.node")) & fits(F.col("size"), F.col("low.size")))
    stars = materialise(stars.groupBy(F.col("node").alias("a"), F.col("low.node").alias("b")).agg(F.count(F.lit(1)).alias("shared")), "stars")
    wanted = banded.join(lowest.select("band"), "band", "leftsemi").select("node").distinct()
    sets = sets_of(docs, key, text, words, nodes.join(wanted, "node", "leftsemi").select("one.key", "one.at"))

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs that aren't in one part yet."""
        pairs = pairs.join(parts.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """The parts as the links between them join them."""
        return _starred(parts.toDF("a", "b").unionByName(links))

    # Each content with the lowest that it shares most bands with; then the other stars, where they could still join parts.
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    parts = _starred(_verified(best, sets, similarity, files))
    parts = joined(parts, _verified(apart(stars, parts), sets, similarity, files))

    def placed_in(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """The rows with comp."""
        return rows.drop("comp").join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def unsettled(rows: DataFrame) -> DataFrame:
        """The rows of bands whose contents are in different parts."""
        mixed = rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
        return rows.join(mixed.select("band"), "band", "leftsemi")

    rest = _gathered(unsettled(placed_in(banded.join(lowest.where("n > 2").select("band"), "band", "leftsemi"), parts)), "unsettled", files)
    # Elements that only one of these contents has: `most` is what a content can have in common with another.
    elements = sets.join(rest.select("node").distinct(), "node", "leftsemi").select("node", F.explode("shingles").alias("e"))
    alone = elements.groupBy("e").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    rest = rest.join(alone, "node", "left").withColumn("most", F.col("size") - F.coalesce("own", F.lit(0)))
    rest = unsettled(rest.where(F.col("most") >= F.lit(similarity - 1e-9) * F.col("size")).drop("own"))

    def could(a: str, b: str):
        common = F.least(f"{a}most", f"{b}most")
        return common >= F.lit(similarity - 1e-9) * (F.col(f"{a}size") + F.col(f"{b}size") - common)

    for k in range(PIVOTS):
        rest = materialise(rest, "unsettled")
        share = F.col("most") / F.col("size")
        first = F.struct(share if k == 0 else F.lit(0.0), F.xxhash64("node", "band", F.lit(k)))
        if k == 2:  # one of the largest part
            largest = rest.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m"), F.max_by(F.struct("node", "size", "most", "comp"), first).alias("pivot"))
            pivots = largest.groupBy("band").agg(F.max_by("pivot", F.struct("m", "comp")).alias("pivot"))
        else:
            pivots = rest.groupBy("band").agg(F.max_by(F.struct("node", "size", "most", "comp"), first).alias("pivot"))
        pairs = rest.join(pivots, "band").where((F.col("comp") != F.col("pivot.comp")) & could("", "pivot.")).select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct()
        parts = joined(parts, _verified(pairs, sets, similarity, files))
        rest = unsettled(placed_in(rest, parts))
    # What is left meets by what few have: of the elements that y can have in common with an x as large or larger, so many that a link must hold one of them.
    rest = materialise(rest, "unsettled")
    left = rest.select("node", "comp", "size").distinct()
    elements = sets.join(left, "node").select("node", "comp", "size", F.explode("shingles").alias("e"))
    spread = elements.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where(f"x = y or n <= {FEW}")
    few = materialise(elements.join(spread.select("e", F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("n")).alias("n")), "e"), "few")  # 0: in one part only
    scarce = few.groupBy("node", "comp", "size").agg(F.count_if(F.col("n") == 0).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "e")))).alias("rarest"))
    both_need = F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-6)  # so many elements a link can lack
    scarce = scarce.withColumn("slack", both_need).where(F.col("alone") + F.size("rarest") > F.col("slack"))
    # A word in common makes as many shingles common as they have words: one more than that tells chance meetings from links.
    take = F.when(F.col("alone") > F.col("slack"), 0).otherwise(F.least(F.size("rarest"), F.col("slack") + words + 1 - F.col("alone"))).cast("int")
    scarce = scarce.withColumn("part", F.slice("rarest.e", F.lit(1), take))
    scarce = materialise(scarce.select("node", "comp", "size", "part", (F.col("size") - F.col("alone") - F.size("part")).alias("others")), "scarce")
    ordered = (F.col("asize") < F.col("bsize")) | ((F.col("asize") == F.col("bsize")) & (F.col("anode") < F.col("bnode")))
    side = lambda n, *more: [F.col(c).alias(f"{n}{c}") for c in ("node", "comp", "size", *more)]
    met = scarce.select(F.explode("part").alias("e"), *side("a", "others")).join(few.where("n > 0").select("e", *side("b")), "e")
    met = met.where((F.col("acomp") != F.col("bcomp")) & ordered & fits(F.col("asize"), F.col("bsize"))).groupBy("anode", "bnode", "asize", "bsize", "aothers").agg(F.count(F.lit(1)).alias("common"))
    met = met.where(F.col("common") + F.col("aothers") >= (F.col("asize") + F.col("bsize")) * (similarity / (1 + similarity)) - 1e-6)
    parts = joined(parts, _verified(met.select(F.col("anode").alias("a"), F.col("bnode").alias("b")), sets, similarity, files))
    # Contents of frequent elements alone are compared pair by pair with what is as large or larger, in the first band of both, by sketches. Sizes within the similarity fall in the same or the next class of sizes.
    rest = placed_in(rest, parts).join(scarce.select("node", F.lit(False).alias("plain")), "node", "left").withColumn("plain", F.coalesce("plain", F.lit(True)))
    last = materialise(_outside(materialise(unsettled(rest), "unsettled")), "last")
    held = _gathered(sketches(sets.join(last.select("node").distinct(), "node", "leftsemi")), "held", files)  # both sides of the join read it
    parts = joined(parts, _verified(_near(last, held, similarity), sets, similarity, files))
    placed = materialise(nodes.join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    drop(nodes, banded, stars, sets, few, scarce, last, held)
    return members, placed


def _outside(rest: DataFrame) -> DataFrame:
    """The rows of bands that hold plain ones, with outside: whether a row is not in the largest part of its band."""
    counts = rest.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.bool_or("plain").alias("plain"))
    largest = counts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.bool_or("plain").alias("any")).where("any")
    return rest.join(largest.drop("any"), "band").withColumn("outside", F.col("comp") != F.col("largest")).drop("largest")


def _near(rest: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a band, in different parts, whose sketches are near enough for a link and of which the smaller (ties by node) is plain. rest: of _outside(); held: the sketches.

    Of two contents in different parts one at least is outside the largest part of the band: such rows meet all rows of the band, and no two rows of the largest part ever meet, which
    would be nearly all pairs of a large group. Sizes within the similarity fall in the same or a neighbouring class of sizes.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    columns = ("node", "comp", "size", "most", "plain")
    side = lambda n, *more: [F.col(c).alias(f"{n}{c}") for c in (*columns, *more)]
    outside = rest.where("outside").join(held, "node").withColumn("own", step).select("band", F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1)).alias("step"), *side("x", "bits"))
    every = rest.join(held, "node").select("band", step.alias("step"), *side("y", "bits"))
    common = F.least("xmost", "ymost")
    could = common >= F.lit(similarity - 1e-9) * (F.col("xsize") + F.col("ysize") - common)
    first = (F.col("xsize") < F.col("ysize")) | ((F.col("xsize") == F.col("ysize")) & (F.col("xnode") < F.col("ynode")))
    differ = sum((F.bit_count(F.get("xbits", F.lit(i)).bitwiseXOR(F.get("ybits", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    apart_by = (1 - similarity) / 2  # the part of the bits that differ between sets just so similar
    near = differ <= int(SKETCH * apart_by + 5 * (SKETCH * apart_by * (1 - apart_by)) ** 0.5)
    met = outside.join(every, ["band", "step"]).where((F.col("xcomp") != F.col("ycomp")) & F.when(first, F.col("xplain")).otherwise(F.col("yplain")) & could & near)
    return met.select(F.when(first, F.col("xnode")).otherwise(F.col("ynode")).alias("a"), F.when(first, F.col("ynode")).otherwise(F.col("xnode")).alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, files: int = 1) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar as that."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = common / (F.size("x") + F.size("y") - common)
    return _gathered(both.where(alike >= similarity - 1e-9).select("a", "b"), "links", files)


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """docs with one row for each class of near duplicates: that of the smallest key (nulls come last), ties by the text's hash.

    Classes are those of contents, so rows that repeat a key with other texts are told apart, and so are rows without a key. Rows that repeat both key and text are one
    document; one of them stays.
    """
    _, nodes = _parts(docs, key, text, similarity, words, bands, rows)
    # A struct with a null equals its like, so the join deals the texts out by the same columns that dropDuplicates() does, and they are shuffled once.
    heads = materialise(nodes.groupBy("comp").agg(F.min("one").alias("one")).select(F.struct("one.key").alias("_darts_key"), F.col("one.at").alias("_darts_at")), "heads")
    marked = docs.withColumns({"_darts_key": F.struct(F.col(key).alias("key")), "_darts_at": F.xxhash64(text)})
    return marked.join(heads, ["_darts_key", "_darts_at"], "leftsemi").dropDuplicates(["_darts_key", "_darts_at"]).select(*docs.columns)
