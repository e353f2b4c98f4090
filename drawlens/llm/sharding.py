"""Jump consistent hashing: stable keys go to shards without a table of the ring."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the published generator, in halves of 32 bits.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
WORD = 1 << 32


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator, state * MULTIPLIER + 1 modulo 2**64, in pieces that no BIGINT overflows."""

    def low_word(a: Column, b: int) -> Column:
        """a * b modulo 2**32, for a below 2**32."""
        return (a * F.lit(b & 0xFFFF) + F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(0xFFFF), 16)) % F.lit(WORD)

    first, second = lo * F.lit(LOW & 0xFFFF) + F.lit(1), lo * F.lit(LOW >> 16)
    total = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(total, 32) + F.shiftright(second, 16)
    return (carry + low_word(hi, LOW) + low_word(lo, HIGH)) % F.lit(WORD), total % F.lit(WORD)


def jump_buckets(key: Column, shards: list[int]) -> Column:
    """A struct with the bucket of a BIGINT key for each count of shards (fields s<count>), and `mix`, 32 well-mixed bits of the key.

    One walk serves all counts: the bucket for n shards is the last place of the walk below n. A null key counts as -1.
    """
    key = F.coalesce(key, F.lit(-1)).cast("long")
    names = [f"s{n}" for n in shards]
    most = max(shards)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("mix"), *[F.lit(0).cast("long").alias(x) for x in names]
    )

    def walk(a: Column, i: Column) -> Column:
        hi, lo = _step(a["hi"], a["lo"])
        far = F.floor((a["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        new = F.struct(
            hi.alias("hi"), lo.alias("lo"), far.alias("j"), F.when(i == 1, hi).otherwise(a["mix"]).alias("mix"), *[F.when(a["j"] < n, a["j"]).otherwise(a[x]).alias(x) for n, x in zip(shards, names)]
        )
        return F.when(a["j"] < most, new).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most + 1)), start, walk, lambda a: F.struct(a["mix"].alias("mix"), *[a[x].alias(x) for x in names]))


def place(df: DataFrame, key: str, shards: int, blocks: int = 512) -> DataFrame:
    """Adds shard, grown_shard (with one shard more) and slot, the place in the shard, gapless from 0.

    Slots follow (block, key, `text_crc32` if there is one), where a shard's blocks are hash ranges of its keys: rows are numbered
    block by block and each block starts where the blocks before it end, so no task sees a whole shard. The table of
    blocks has at most shards * blocks rows, which is the bound for its broadcast. Repeated keys share a shard and get slots of
    their own; a null key counts as -1; an empty table gives an empty result. Columns of df that bear a name of the result are replaced.
    """
    made = {"shard", "grown_shard", "slot"}
    kept = [c for c in df.columns if c not in made]
    ties = F.struct(*[df[c] for c in [key] + ["text_crc32"] * ("text_crc32" in df.columns)])
    df = df.select(F.struct(*[df[c] for c in kept]).alias("_kept"), ties.alias("_ties"), jump_buckets(df[key], [shards, shards + 1]).alias("_at"))
    block = F.shiftright(F.col("_at.mix") * F.lit(blocks), 32).cast("int")
    df = df.select("_kept", "_ties", F.col(f"_at.s{shards}").cast("int").alias("shard"), F.col(f"_at.s{shards + 1}").cast("int").alias("grown_shard"), block.alias("_block"))
    counts = df.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_ties"))
    out = df.withColumn("_row", row).join(F.broadcast(starts), ["shard", "_block"])
    return out.select(*[F.col(f"_kept.`{c}`").alias(c) for c in kept], "shard", "grown_shard", (F.col("_start") + F.col("_row") - 1).alias("slot"))
