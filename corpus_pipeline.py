"""From raw documents to packed training sequences.

Each stage works on all its predecessor kept. Its table is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, language, packing, secrets
from lodestar.llm.common import remove, shared_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, whose language is undetermined, go; lang becomes the prediction.

    Profiles are fitted on the stage's own labelled rows.
    """
    said = language.predict(docs, language.profiles(docs), out=("_lodestar_lang", "_lodestar_score")).where("_lodestar_lang <> 'und'")
    lang = F.col("_lodestar_lang").alias("lang")
    return said.select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five-word shingles, similarity 0.8: of each group of near duplicates one text stays, that of the smallest doc_id.

    Texts are decided on, not ids: another text under the id of a near duplicate stays. A null id is the largest of its group.
    Of several texts under the smallest id the one with the least MD5 stays. Documents without words are no duplicates of each other. Rows that repeat id and text are one.
    """
    same = jaccard.join(docs, n=5, num=8, den=10, texts=True)
    go = same.where("n_shingles > 0 and not (doc_id <=> first.doc_id and key = first.key)").select(F.col("doc_id").alias("_lodestar_id"), F.col("key").alias("_lodestar_key")).distinct()
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(go, docs.doc_id.cast("long").eqNullSafe(F.col("_lodestar_id")) & (text == F.col("_lodestar_key")), "left_anti")
    twice = docs.select("doc_id", text.alias("_lodestar_text")).groupBy("doc_id", "_lodestar_text").count().where("count > 1")
    if not twice.isEmpty():  # rows are only moved to be made one where some repeat
        kept = kept.withColumn("_lodestar_text", text).dropDuplicates(["doc_id", "_lodestar_text"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage go."""
    return decontaminate.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every secret in a text is replaced by a mark; no document goes."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [("language_id", identify), ("jaccard_join", deduplicate), ("decontamination", decontaminated), ("secret_scan", redacted), ("packing", packed)]

#: Tokenising, forward profiles and secret spans are beyond SQL; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes once its successor's is written, the last one's when Python exits."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/lodestar-pipeline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
