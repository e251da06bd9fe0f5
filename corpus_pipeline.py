"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before kept: toxic documents go, documents whose language the
compressors cannot tell (no letter, or a margin narrower than all but one in 200 sampled
documents have) go, one document of each class of near copies stays, personal data
is replaced by its kind, and what is left is packed into sequences.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termfield.llm import langid, nearcopies, packing, pii, toxicity
from termfield.llm.common import discard, docs_of, place, written
from termfield.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, _ = toxicity.learn(docs, labels, F.lit(True))
    return toxicity.keep_clean(docs, model)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: No stage can be said in SQL: classifiers, compressors and tokenizers decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        since = place()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            # What the stage wrote on its way, and the documents before it, are spent.
            discard(spark, max(0, since - (k > 0)))
    return docs
