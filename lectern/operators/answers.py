"""Answers put together from passages, their citations and the credit they earn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.functions.common import first_row
from lectern.session import cut_lineage


def _candidates(passages: DataFrame, questions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sentences that could be picked, with the question terms they hold."""
    asked = questions.select(*key, X.term_set(F.col("q"), V.ANSWER_STOPWORDS, V.ANSWER_MIN_TERM).alias("q_terms"))
    split = passages.select(*key, "rank", "label", F.posexplode(X.sentences(F.col("text"))).alias("pos", "raw"))
    split = split.withColumn("sentence", P.strip(F.col("raw")))
    size = F.length("sentence")
    split = split.where((size > V.ANSWER_SENTENCE_MIN) & (size < V.ANSWER_SENTENCE_MAX))
    terms = X.term_set(F.col("sentence"), V.ANSWER_STOPWORDS, V.ANSWER_MIN_TERM)
    joined = split.join(asked, list(key)).withColumn("overlap", F.array_intersect(terms, "q_terms"))
    return joined.where(F.size("overlap") > 0).select(*key, "rank", "pos", "label", "sentence", "overlap")


def extractive_answer(passages: DataFrame, questions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Up to four sentences per question that together cover most of its terms.

    Greedy: each step takes the sentence with the largest gain among those of the course of the first
    pick. The steps are four joins over all questions at once; no question's candidates are gathered.

    `passages`: key, rank (0-based), label, course_id, text.
    """
    key = list(key)
    pool = _candidates(passages, questions, key).withColumn("course", P.strip(F.split_part(F.expr("substring(label, 2)"), F.lit(","), F.lit(1))))
    # the same sentence can be said twice: only its best place can ever be chosen
    pool = cut_lineage(first_row(pool, [*key, "course", "sentence"], [F.asc("rank"), F.asc("pos")]))
    state = pool.select(*key).distinct().withColumns(
        {"covered": F.array().cast("array<string>"), "taken": F.array().cast("array<string>"), "locked": F.lit(None).cast("string")}
    )
    picks = None
    for step in range(V.ANSWER_MAX_SENTENCES):
        weight = 1.0 / (1.0 + V.ANSWER_RANK_DECAY * F.col("rank"))
        gain = (F.size(F.array_except("overlap", "covered")) + V.ANSWER_OVERLAP_WEIGHT * F.size("overlap")) * weight
        open_rows = pool.join(state, key).where(
            (F.col("locked").isNull() | (F.col("course") == F.col("locked"))) & ~F.array_contains("taken", F.col("sentence"))
        )
        ranked = open_rows.withColumn("gain", F.round(gain, 9)).where("gain > 0")
        best = cut_lineage(first_row(ranked, key, [F.desc("gain"), F.asc("rank"), F.asc("pos")]))
        chosen = best.select(*key, F.lit(step).alias("step"), "rank", "label", "sentence")
        picks = chosen if picks is None else picks.unionByName(chosen)
        state = best.select(
            *key,
            F.array_union("covered", "overlap").alias("covered"),
            F.concat("taken", F.array("sentence")).alias("taken"),
            F.coalesce("locked", "course").alias("locked"),
        )
    return picks


def answer_text(picks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The answer string and the labels it uses, from the picks of a question (at most four)."""
    rows = F.array_sort(F.collect_list(F.struct("step", F.concat("sentence", F.lit(" "), "label").alias("said"), "label")))
    return picks.groupBy(*key).agg(
        F.array_join(F.transform(rows, lambda r: r["said"]), " ").alias("answer"),
        F.array_distinct(F.transform(rows, lambda r: r["label"])).alias("labels"),
    )


def citation_dedupe(citations: DataFrame, used: DataFrame, key: Sequence[str]) -> DataFrame:
    """First citation of each chunk among those whose label the answer uses."""
    kept = citations.join(used.select(*key, "label").distinct(), [*key, "label"], "left_semi")
    return first_row(kept, [*key, "chunk_id"], [F.asc("rank")])


def citation_split(text: Column) -> Column:
    """Brackets that combine several page references become one bracket each."""
    cut = F.split(F.regexp_replace(text, F.lit("(" + V.CITATION_BLOCK + ")"), F.lit("\u0001$1\u0001")), "\u0001")

    def split(piece: Column, i: Column) -> Column:
        labels = F.regexp_extract_all(piece, F.lit(V.CITATION_LABEL), F.lit(0))
        several = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
        return F.when((i % 2 == 1) & (F.size(labels) > 1), several).otherwise(piece)

    return F.array_join(F.transform(cut, split), "")


def engagement_credit(citations: DataFrame, question: Sequence[str]) -> DataFrame:
    """One question of credit per chapter and question, however many passages it cites."""
    once = citations.select("user_id", *question, "chapter_ref").distinct()
    return once.groupBy("user_id", "chapter_ref").agg(F.count("*").alias("questions"))
