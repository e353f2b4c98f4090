"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.llm import ann, bpe, centroids, darts, fim, gif, line_runs, lm, mixing, pii, rules, secrets, sharding, spans
from drawlens.llm.scratch import drop, materialise

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int):
    """Whether the row's fold, by its doc_id, is 2. Rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 2, F.lit(False))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", held_out(7).alias("held_out"), "text")
    model = lm.fit(docs.where(~F.col("held_out")))
    return lm.score(docs, model)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op3_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return darts.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(found, secrets.KINDS, {"n_assign": secrets.ASSIGN, "n_access": secrets.ACCESS, "n_hex": secrets.HEX})


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return gif.features(gif.stored(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = rules.fit(docs, _table(spark, sf_dir, "labels").where(~held_out(4)))
    return rules.scored(docs, ensemble).select("doc_id", held_out(4).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.place(docs, "doc_id", 16).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(found, pii.KINDS, {"n_email": pii.EMAIL, "n_ip": pii.IP, "n_card": pii.CARD, "n_phone": pii.PHONE})


def _digest(found: DataFrame, kinds: list[str], counts: dict[str, int]) -> DataFrame:
    base = F.sha2(spans.joined(spans.base_of(F.col("spans")), kinds).cast("binary"), 256)
    counted = [spans.count_of(F.col("spans"), k).alias(n) for n, k in counts.items()]
    return found.select("doc_id", *counted, base.alias("base_sha256"), spans.joined(F.col("spans"), kinds).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of the documents are put in order of their positions and written; the rows are those of the uses, put together by document."""
    docs = _table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    sizes = materialise(docs, "sizes")  # texts are read once
    mixed = materialise(mixing.mix(sizes, "source", "size", ["doc_id", "text_key"]), "mixed")
    drop(sizes)
    ordered = materialise(mixing.in_order(mixed, "size"), "ordered")
    rows = mixing.by_row(ordered, mixed, ["row", "doc_id", "size", "source_size", "target"])
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def _sha256(text):
    return F.sha2(text.cast("binary"), 256)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.rearranged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(again).alias("restored_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", _sha256(F.array_join("centroid", ",")).alias("centroid_sha256"))


def queries() -> dict:
    return {"op1_lm": op1_lm, "op2_bpe": op2_bpe, "op3_darts": op3_darts, "op4_ann": op4_ann, "op5_secrets": op5_secrets, "op6_gif": op6_gif, "op7_quality": op7_quality, "op8_sharding": op8_sharding, "op9_pii": op9_pii, "op10_mixing": op10_mixing, "op11_lines": op11_lines, "op12_fim": op12_fim, "op13_centroids": op13_centroids}


def oracle_sql() -> dict[str, str]:
    from drawlens.llm.oracles import op8, op10, op11, op12, op13

    return {"op8_sharding": op8(), "op10_mixing": op10(), "op11_lines": op11(), "op12_fim": op12(), "op13_centroids": op13()}
