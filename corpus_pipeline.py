"""From raw documents to token ids: language ID, near-dedup, PII, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. The stages keep clean documents: the first drops texts without a
letter or under the calibrated threshold, the second all but one document of each class of
near duplicates, the third only rewrites spans, and the fourth repeats or thins documents
by their fitted rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import common, langid, mixing, pieces, pii, probminhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    columns = docs.columns
    marked = langid.identify(docs, langid.train(docs))
    return marked.filter("not rejected").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.deduplicated(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    labels = common.read(spark, sf_dir, "labels").select("doc_id")
    return mixing.applied(docs, mixing.mix(docs, labels))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their best piece ids; workers remember less, as other stages ran in them."""
    return pieces.encoded(docs, pieces.load(), remembered=300_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", private_data), ("mixing", mix_sources), ("sentencepiece", piece_ids)]

#: No stage but the filters can be expressed in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.table(docs)
    return docs
