"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, capfilters, langid, mixing, packing, phrases, pii, secrets, simhash, sparse_suffix, toxicity, warc, whitening
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op2_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", F.sha1("record").alias("record_sha1"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_mentions")


def op4_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_spans(_table(spark, sf_dir, "documents"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    told = whitening.transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error, explained = (model.n, model.identity_error, model.explained) if model else (0, 0.0, [])
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at"))
    return told.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    counts = [F.size(secrets.of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE]
    base = F.sha2(secrets.listed(secrets.of_kind(spans, *secrets.BASE)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op13_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_multiprobe_neighbours, op2_content_addressed_warc, op3_surrogates, op4_concatenate_and_cut, op5_crf_language, op6_sparse_suffixes, op7_cap_filters, op8_target_weights, op9_golay_simhash, op10_kneser_ney_toxicity, op11_cholesky_whitening, op12_structural_secrets, op13_toivonen_phrases)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
