"""A training-corpus pipeline over the documents table. Each stage is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.llm import bpe, decontaminate, jaccard_join, langid, secret_scan
from grainsieve.llm.textcore import quoted, unused
from grainsieve.runtime import materialize, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: null texts and texts without a letter. lang becomes the prediction.

    If there is nothing to learn from, as without any lang, the same documents go and lang stays as it is.
    """
    model = langid.learned(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = tuple(unused(x, docs.columns) for x in ("lang_pred", "score", "lang_spans"))
    found = langid.identify(docs, model, called=named).where(F.col(named[0]) != langid.UNKNOWN)
    return found.withColumn("lang", F.col(named[0])).select(*map(quoted, docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one of smallest doc_id stays.

    Documents without words link with nothing and stay; those of null doc_id stay, but others may link through them; rows that repeat a doc_id stay together.
    """
    found = jaccard_join.jaccard_components(docs, words=5, threshold=(8, 10))
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words are cut out; texts that are more than half benchmark words go.

    Null texts, empty ones and those without a hit stay as they are, and so do repeated rows; without benchmark items nothing is cut.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, most_coverage=0.5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. Null and empty texts have none; in an empty table there is nothing to learn from, and only the patterns count."""
    return secret_scan.mask(docs, secret_scan.fit(secret_scan.sample_texts(docs)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids; null and empty texts have no token. Other columns are dropped."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("secret_scans", mask_secrets),
    ("bpe_encoding", encode_texts),
]

#: SQL can express neither the learned stages nor BPE; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
