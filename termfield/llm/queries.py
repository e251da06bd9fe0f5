"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, dropout, images, langid, license, merkle, nearcopies, packing, pii, repair, toxicity, vptree, whitening
from .common import docs_of, fold


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, votes = toxicity.learn(docs_of(spark, sf_dir), labels, fold("doc_id", 3) != 1)
    return toxicity.score(votes, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "votes",
    )


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    model, words = brown.learn(docs, fold("doc_id", 5) != 1)
    found = brown.score(docs, model, words)
    return found.select(
        "doc_id",
        (fold("doc_id", 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return pii.find(docs, pii.learn(docs))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(docs_of(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's picture (variant 0) and the edited copies (variant 1), by smallest vec_id of the class."""
    found = images.copies(images.rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    half = F.floor(F.col("media_id") / 2).cast("long")
    return found.select(half.alias("vec_id"), (F.col("media_id") % 2).cast("int").alias("variant"), F.floor(F.col("class_id") / 2).cast("long").alias("class_id"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs_of(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vptree.neighbours(vectors, F.col("vec_id") % 100 == 0, k=10, factor=4.0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    found = langid.identify(docs, langid.learn(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(docs_of(spark, sf_dir))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropout.round_trip(docs_of(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.succession(docs_of(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_brown, op3_pii, op4_near_copies, op5_image_copies, op6_packing, op7_vptree, op8_langid, op9_license, op10_merge_dropout, op11_merkle, op12_whitening, op13_repair)}
ORACLE_SQL: dict[str, str] = {"op9_license": license.sql()}
