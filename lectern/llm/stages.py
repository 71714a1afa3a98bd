"""What the pipeline's stages add to the operators: which rows of a table an operator's decision keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.jaccard import similar_components
from lectern.llm.pii import pseudonymise


def one_per_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The document with the smallest key of each component of `similar_components`, all columns as they are.

    Rows that repeat a key are one document; the first of them in the order of all other columns stays. Rows with a
    null key and texts without a word are no copies and stay. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != key]
    groups = similar_components(docs, key=key, text=text, words=words, num=num, den=den)
    # a copy of a key has this key's component, so a key is first or not, whatever the row
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    # repeats fold map-side before the shuffle, and the join needs no other one
    single = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    single = single.join(first, single[key].cast("long") == F.col("_first"), "left_semi").select(key, "_row.*")
    return single.unionByName(docs.where(F.col(key).isNull())).select(docs.columns)


def without_personal_numbers(docs: DataFrame, *, text: str = "text", size: str = "n_chars", **options) -> DataFrame:
    """`docs` with pseudonyms in `text`; `size`, where there is such a column, is the length of the new text.

    Null texts stay null and keep their `size`. An empty table gives an empty table.
    """
    done = pseudonymise(docs, text=text, count=None, **options)
    if size in docs.columns:
        done = done.withColumn(size, F.coalesce(F.length(text).cast(docs.schema[size].dataType), F.col(size)))
    return done
