"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. quality classifier: documents scored below one half go;
2. n-gram Jaccard join: the document with the smallest id of each group stays;
3. suffix-array dedup: text that repeats a document with a smaller id is cut out (a document stays, even if empty);
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: ids of what is left, and the digest of the decoded ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotables.llm import byte_bpe, ngram_jaccard, quality_mil, suffix_dedup, template_decontam
from biotables.llm.columns import table
from biotables.session import configure, materialize

#: the columns of documents, in their order
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    return quality_mil.score(docs, model).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.representatives(configure_for(spark, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(configure_for(spark, docs), in_place=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = template_decontam.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]


def configure_for(spark: SparkSession, docs: DataFrame) -> DataFrame:
    configure(spark)
    return docs.select(*COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialize(docs, f"stage{place + 1}")
    return docs


#: the first stage is a learned model; tests hold every stage against a plain version
ORACLE_SQL = None
