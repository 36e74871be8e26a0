"""A corpus pipeline: language ID, near-duplicate removal, surrogates, mixing and packing.

Each stage reads what the one before wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import langid, mixing, packing, pii, simhash
from evidentia.llm.staging import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose language is less certain than this is rejected, like one without letters.
CERTAIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the model knows, by most of their words. Null and empty texts, and those without letters, are rejected; other columns stay as they are."""
    rows = docs.select("text", F.struct("*").alias("_row"))
    known = langid.identify(rows, langid.fit(docs))
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN)).select("_row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; null ids stay once a group that has no other."""
    return simhash.keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text. Null texts stay null."""
    return pii.replace_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, nulls being one source; those without words are taken no time if their source has none."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of packing.WINDOW ids; a null or empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("surrogates", surrogates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Language ID, SimHash and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
