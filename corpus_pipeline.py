"""Documents to training tokens: quality, near duplicates, personal data, mixing of sources, byte-level BPE."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.llm import bpe, darts, mixing, pii, rules
from drawlens.llm.queries import WORD, held_out
from drawlens.llm.scratch import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier predicts as bad; it learns from the labels outside the held-out fold.

    Every row is judged by its text alone (null counts as empty), so repeated rows and rows without an id are judged alike; without any label nothing can be learned, and rules.fit() says so.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = rules.fit(docs.select("doc_id", "text"), labels.where(~held_out(4)))
    return rules.scored(docs, ensemble).where(F.col("predicted") == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the smallest id; rows are told apart by id and text (darts.kept())."""
    return darts.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, <email>. A null text stays null."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come near their targets: one row for each use of a document, in the order of the uses' positions.

    The order is that of the rows in the files, as the columns are those of documents. A null text has no words and is never taken; a null source is a source; rows that agree in id and text are taken alike. Working columns
    have names that docs doesn't have.
    """
    size, key = (next(n for n in (f"_{c}{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("size", "text_key"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.withColumn(size, F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn(key, F.md5(text.cast("binary")))
    return mixing.in_order(mixing.mix(sized, "source", size, ["doc_id", key])).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each use of a document, as counts and digests. A null text has no tokens."""
    import public_tokenizers

    return bpe.tokenised(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixed", mixed), ("encoded", encoded)]
# SQL has no trained classifier, MinHash or BPE; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
