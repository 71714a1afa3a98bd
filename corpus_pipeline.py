"""The corpus pipeline: from raw documents to a drawing plan of a clean, deduplicated, mixed corpus.

1. Language ID: documents whose language is undetermined (no text, no letter) or of a posterior below a half go.
2. N-gram Jaccard join: of linked documents (five-word shingles, similarity 0.8) the one with the smallest id stays.
3. Benchmark decontamination: documents that repeat a test item go.
4. PII: personal numbers become pseudonyms of the same format.
5. Mixing: documents are drawn by temperature-scaled source weights. The result is the plan: a row for each draw,
   with its place in the permutation; a repeated text is named again, not copied.

Stages 1 to 4 return the columns of their input. Null ids, repeated rows, empty texts and empty tables have the
results that the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import drop_contaminated
from lectern.llm.langid import keep_identified
from lectern.llm.mixing import mix_sources
from lectern.llm.shared import bucket_of, prepare, store, table
from lectern.llm.stages import one_per_group, without_personal_numbers

#: A language is determined if it is likelier than all others together.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, LEAST_POSTERIOR, docs.where(bucket_of(F.col("doc_id"), 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_numbers(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("mixing", mixing),
]
#: Expectation maximisation over segmentations has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
