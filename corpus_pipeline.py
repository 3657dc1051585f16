"""A corpus pipeline: language, quality, near duplicates, personal data, packing.

Every stage works on all that the one before kept. All but the last return the columns of documents, as they came,
whatever else is in them. Ids may be null or repeated; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import jaccard, language, packing, pii, quality, vocabulary
from pixelloom.llm.common import cut, free


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which string kernels recognise a language: the one predicted must be among the learned ones, and
    have most of the text's n-grams. Those without text or letters go, as do all where nothing can be learned."""
    return language.recognised(docs, language.learn(docs))


def compressible(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their compression bands keep; null and empty texts go, as they have no words.
    Rows that repeat are judged alike."""
    return quality.kept(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest id, ids before none; of rows that share it, the
    one whose text has the smallest hash.

    Rows are compared by themselves, whatever their id: those that share an id but not a text may be in different
    components, and rows without an id link too. A text without words links to nothing but its own copies under its id."""
    row, id_ = "pixelloom_row", F.col("doc_id").cast("long")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), compression="zstd")  # a written table, so that the numbers stay
    linked = jaccard.link_components(numbered, id_col=row).select(F.col("doc_id").alias("linked"), "component_id", "n_shingles")
    rows = numbered.select(row, id_.alias("id"), F.xxhash64("text").alias("hash")).join(linked, F.col(row) == F.col("linked"))
    wordless = F.col("n_shingles") == 0
    keys = [F.when(~wordless | F.col("id").isNull(), F.col("component_id")).alias("component"), F.when(wordless, F.col("id")).alias("alone"), F.when(wordless, F.col("hash")).alias("copy")]
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull(), "id", "hash", row)).alias("first")).select(F.col(f"first.{row}").alias("first"))
    return numbered.join(first, numbered[row] == first["first"], "left_semi").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the text, and n_chars to match, which is null for a null text. No row goes."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; a null text counts as empty and has its end id."""
    return packing.pack(docs, vocabulary.public_path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("quality", compressible),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: No stage's model, compression or tokenizer can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole documents table: the packed pieces of what is kept. Each stage's
    output is a table, which goes when the next stage's is there."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        if made is not None:
            free(made)
        docs = made = kept
    return STAGES[-1][1](spark, docs, sf_dir)
