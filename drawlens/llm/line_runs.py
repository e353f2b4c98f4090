"""Line dedup by levelled sorted runs of line hashes, by built-in functions only."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.llm.scratch import drop, folder, materialise

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 4096  # a key of more than this part of a batch's lines is hot: there are fewer hot keys than this


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """doc, row, i, a, b: the lines whose keys have at least `least` code points. a and b are a key's hash of 128 bits, row is a hash of the text, i the place of the line from 0."""
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc].alias("doc"), F.xxhash64(whole).alias("row"), F.posexplode(F.split(whole, "\n", -1)).alias("i", "line"))
    rows = rows.select("doc", "row", "i", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return rows.select("doc", "row", "i", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


class Runs:
    """Sorted runs of line hashes on levels. A run is a table bucketed and sorted by hash, so a batch that is dealt to the same buckets merges with it and the run isn't shuffled.

    A new run goes to the lowest level. A level of `fan` runs is merged into one run of the next level before more is added, so there are fewer than `fan` runs a level and a hash is rewritten once a level. Tables
    lie in the folder that driver and executors share; close() deletes them.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = 2):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"drawlens_run_{uuid.uuid4().hex}"
        rows.write.format("orc").option("compression", "lz4").option("path", f"{folder(self.spark)}/{name}").bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(name)
        return name

    def _delete(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(self.spark)}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _keys(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen").select("a", "b")

    def _compact(self) -> None:
        for at, level in enumerate(self.levels):
            if len(level) < self.fan:
                return
            both = self._keys(level[0])
            for name in level[1:]:
                both = both.unionByName(self._keys(name))
            merged = self._write(both.repartition(self.buckets, "a", "b").withColumn("seen", F.lit(False)))
            for name in level:
                self._delete(name)
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)

    def add(self, keys: DataFrame) -> DataFrame:
        """keys (a, b, and more; one row a hash) with seen, whether an earlier batch had the hash; the others are the batch's own run from now on."""
        self._compact()
        seen = F.lit(False)
        for i, name in enumerate(name for level in self.levels for name in level):
            run = self._keys(name).withColumn(f"in_{i}", F.lit(True))
            keys = keys.join(run.hint("merge"), ["a", "b"], "left")
            seen = seen | F.col(f"in_{i}").isNotNull()
        name = self._write(keys.withColumn("seen", seen).drop(*[c for c in keys.columns if c.startswith("in_")]))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in (name for level in self.levels for name in level):
            self._delete(name)
        self.levels = []


def _marked(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """doc, row, i of the lines to drop. Lines of hot keys meet their keys by a broadcast of fewer than HOT rows; no other key has more than one line in HOT."""
    gone = keys.where("seen or several").select("a", "b", "seen", "owner", "n")
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(gone.where(F.col("n") * HOT > total).drop("n"))
    rest = gone.where(F.col("n") * HOT <= total).drop("n")
    lost = F.col("seen") | ~F.col("doc").eqNullSafe(F.col("owner"))
    often = lines.join(hot, ["a", "b"])
    seldom = lines.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(rest.hint("merge"), ["a", "b"])
    return often.unionByName(seldom).where(lost).select("doc", "row", "i")


def _without(lines: Column, lost: Column) -> Column:
    """The lines joined again without those at the ascending places `lost`, in one pass: pieces between two lost places are cut out whole."""

    def pieces(x: Column) -> Column:
        before, after = (lambda j: F.coalesce(F.get(x["lost"], j - 1), F.lit(-1))), (lambda j: F.coalesce(F.get(x["lost"], j), F.size(x["lines"])))
        kept = F.transform(F.sequence(F.lit(0), F.size(x["lost"])), lambda j: F.slice(x["lines"], before(j) + 2, after(j) - before(j) - 1))
        return F.array_join(F.flatten(kept), "\n")

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), lost.alias("lost"))), pieces), F.lit(0))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 10, batches: int = 4, fan: int = 2) -> DataFrame:
    """docs without the text, with n_lines, n_dropped and kept: the text without the lines whose key (key_of()) another document with a smaller id has, too.

    A key of at least `least` code points that several documents hold keeps its lines in the document of the smallest id alone. Documents come in `batches`, ranges of ids in ascending order: hashes
    that an earlier batch has in its runs are dropped, what is new becomes the batch's run (Runs).
    A null text counts as empty, which is one empty line. Rows with one id are one document. Rows without an id are one document, the last. Ids that are not whole numbers all come in one batch. Equal rows give equal results; an empty table
    gives an empty result; columns of docs that bear a name of the result are replaced.
    """
    made = {"n_lines", "n_dropped", "kept"}
    others = [c for c in docs.columns if c != text and c not in made]
    place = F.lit(0)
    ranged = batches > 1 and dict(docs.dtypes)[doc] in ("int", "bigint")
    for bound in docs.approxQuantile(doc, [i / batches for i in range(1, batches)], 0.01) if ranged else []:
        place = place + (F.col("doc") > bound).cast("int")
    lines = materialise(lines_of(docs, doc, text, least).withColumn("batch", F.coalesce(place, F.lit(batches - 1))), "lines")
    runs = Runs(docs.sparkSession, fan=fan)
    marks = []
    try:
        for batch in range(batches):
            own = lines.where(F.col("batch") == batch)
            nobody = F.max(F.col("doc").isNull())
            keys = own.groupBy("a", "b").agg(F.min("doc").alias("owner"), ((F.min("doc") != F.max("doc")) | (nobody & F.min("doc").isNotNull())).alias("several"), F.count(F.lit(1)).alias("n"))
            keys = runs.add(keys.withColumn("several", F.coalesce("several", F.lit(False))))
            marks.append(materialise(_marked(own, keys), "marks"))
    finally:
        runs.close()
    drop(lines)
    lost = marks[0]
    for more in marks[1:]:
        lost = lost.unionByName(more)
    lost = lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("i")).alias("_lost")).withColumnRenamed("doc", "_doc").withColumnRenamed("row", "_row")
    base = docs.select(docs[doc].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text"), F.struct(*[docs[c] for c in others]).alias("_kept"))
    both = base.join(lost, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_row")), "left")
    split = F.split("_text", "\n", -1)
    n_lost = F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(_without(split, F.col("_lost")))
    return both.select(*[F.col(f"_kept.`{c}`").alias(c) for c in others], F.size(split).cast("long").alias("n_lines"), n_lost.cast("long").alias("n_dropped"), kept.alias("kept"))
