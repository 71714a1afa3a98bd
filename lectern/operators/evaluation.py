"""Retrieval, refusal and grounding metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as X
from lectern.functions.common import exact_avg, ratio, top_rows

METRICS = ["r1", "r3", "r5", "r10", "mrr", "ndcg10"]


# --- gold labels -------------------------------------------------------------------------


def gold_interval_join(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the span's source whose page range overlaps the labelled one.

    Pages are cut into bands of 32; a chunk or span is listed in each band it touches, the join is an
    equi-join on (tenant, source, band), and a pair counts in the band where its overlap starts.
    """
    band = 32

    def bands(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / band), F.floor(F.greatest(low, high) / band)))

    left = spans.withColumn("band", bands(F.col("page_lo"), F.col("page_hi")))
    right = chunks.select("user_id", "source_id", "chunk_id", "page_start", "page_end")
    right = right.withColumn("band", bands(F.col("page_start"), F.col("page_end")))
    overlap = (F.col("page_start") <= F.col("page_hi")) & (F.col("page_end") >= F.col("page_lo"))
    first_band = F.floor(F.greatest("page_start", "page_lo") / band)
    joined = left.join(right, ["user_id", "source_id", "band"])
    return joined.where(overlap & (F.col("band") == first_band)).drop("band")


def gold_validate(questions: DataFrame, spans: DataFrame, resolved: DataFrame) -> DataFrame:
    """Label problems as rows (user_id, q_id, problem). A span without a source states no gold."""
    key = ["user_id", "q_id"]
    spans = spans.where("source_id IS NOT NULL")
    duplicate = questions.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate id").alias("problem"))
    inside = questions.where("in_corpus").select(*key).distinct()
    without = inside.join(spans.select(*key), key, "left_anti").withColumn("problem", F.lit("in corpus without gold"))
    nothing = spans.select(*key).distinct().join(resolved.select(*key), key, "left_anti")
    return duplicate.unionByName(without).unionByName(
        nothing.withColumn("problem", F.lit("gold span matches nothing"))
    )


def slice_rollup(questions: DataFrame) -> DataFrame:
    """Counts per slice with the grand total as slice 'total'."""
    out = questions.rollup("slice").agg(
        F.count("*").alias("n"), F.count_if("in_corpus").alias("in_corpus"), F.count_if(~F.col("in_corpus")).alias("outside")
    )
    return out.withColumn("slice", F.coalesce("slice", F.lit("total")))


# --- retrieval metrics ---------------------------------------------------------------------


def ir_metrics(ranked: DataFrame, gold: DataFrame, key: Sequence[str], depth: int = 10) -> DataFrame:
    """Hit rate at 1, 3, 5 and 10, reciprocal rank and nDCG@10 of every question with gold.

    `ranked` holds 0-based ranks; `gold` may carry further columns that are functions of the key.
    """
    key = list(key)
    extra = [c for c in gold.columns if c not in (*key, "chunk_id")]
    sizes = gold.groupBy(*key, *extra).agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") < depth).join(gold.select(*key, "chunk_id"), [*key, "chunk_id"])
    found = hits.groupBy(*key).agg(
        (F.min("rank") + 1).alias("best"),
        F.sum((1.0 / F.log2(F.col("rank") + 2)).cast("decimal(38,12)")).cast("double").alias("dcg"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(depth)).cast("int")),
        F.lit(0.0),
        lambda total, i: total + 1.0 / F.log2(i + 1),
    )
    out = sizes.join(found, key, "left")
    at = {f"r{k}": F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0)) for k in (1, 3, 5, 10)}
    return out.select(
        *key,
        *extra,
        *[value.alias(name) for name, value in at.items()],
        F.coalesce(F.round(1.0 / F.col("best"), 6), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.round(F.col("dcg") / ideal, 6), F.lit(0.0)).alias("ndcg10"),
    )


def ir_metrics_rollup(metrics: DataFrame, *dims: str) -> DataFrame:
    """Mean metrics per `dims` and over the last of them ('all')."""
    last = dims[-1]
    sets = metrics.withColumn(last, F.explode(F.array(F.col(last), F.lit("all"))))
    return sets.groupBy(*dims).agg(
        F.count("*").alias("n"), *[F.round(exact_avg(F.col(m)), 4).alias(m) for m in METRICS]
    )


def ir_misses(ranked: DataFrame, gold: DataFrame, key: Sequence[str], depth: int = 10) -> DataFrame:
    """Questions with gold none of whose gold chunks are among the first `depth`."""
    hits = ranked.where(F.col("rank") < depth).join(gold, [*key, "chunk_id"], "left_semi")
    return gold.select(*key).distinct().join(hits, list(key), "left_anti")


def first_gold_rank(ranked: DataFrame, gold: DataFrame, key: Sequence[str]) -> DataFrame:
    """1-based rank of the first gold chunk per question, null when it is not retrieved."""
    hits = ranked.join(gold.select(*key, "chunk_id"), [*key, "chunk_id"])
    best = hits.groupBy(*key).agg((F.min("rank") + 1).alias("first_rank"))
    return gold.select(*key).distinct().join(best, list(key), "left")


# --- refusal ----------------------------------------------------------------------------------


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)

    def f_beta(beta: float) -> Column:
        b2 = beta * beta
        return ratio((1 + b2) * precision * recall, b2 * precision + recall)

    return counts.withColumns(
        {
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": F.round(f_beta(1.0), 4),
            "f2": F.round(f_beta(2.0), 4),
            "answer_rate": F.round(ratio(tn, tn + fp), 4),
        }
    )


def refusal_scores(judged: DataFrame, threshold: float = V.REFUSAL_THRESHOLD) -> DataFrame:
    """Confusion counts and scores with and without the intent gate.

    `judged`: in_corpus, live_data, confidence, gated. Live-data questions are left out.
    """
    scored = judged.where(~F.col("live_data")).withColumn("gate", F.explode(F.array(F.lit(True), F.lit(False))))
    refused = (F.col("confidence") < threshold) | (F.col("gate") & F.col("gated"))
    inside = F.col("in_corpus")
    counts = scored.withColumn("refused", refused).groupBy("gate").agg(
        F.count_if(~inside & F.col("refused")).alias("tp"),
        F.count_if(inside & F.col("refused")).alias("fp"),
        F.count_if(~inside & ~F.col("refused")).alias("fn"),
        F.count_if(inside & ~F.col("refused")).alias("tn"),
    )
    return _scores(counts)


def threshold_sweep(judged: DataFrame, low: float = 0.02, high: float = 0.95, steps: int = 94) -> DataFrame:
    """Scores at every threshold of the grid, the best marked.

    Each question is counted once, in the first grid step that refuses it; running sums over the
    grid then give every threshold, so the questions are never multiplied by the grid.
    """
    spark = judged.sparkSession
    usable = judged.where(~F.col("live_data"))
    grid = F.sequence(F.lit(0), F.lit(steps))
    thresholds = F.transform(grid, lambda i: F.lit(low) + F.lit(high - low) * i / steps)
    first = F.when(F.col("gated"), 0).otherwise(
        F.size(F.filter(thresholds, lambda t: t <= F.col("confidence")))
    )
    histogram = usable.groupBy(first.alias("step")).agg(
        F.count_if(~F.col("in_corpus")).alias("outside"), F.count_if("in_corpus").alias("inside")
    )
    empty = spark.range(steps + 1).select(
        F.col("id").cast("int").alias("step"), F.lit(0).cast("long").alias("outside"), F.lit(0).cast("long").alias("inside")
    )
    per_step = histogram.unionByName(empty).groupBy("step").agg(
        F.sum("outside").alias("outside"), F.sum("inside").alias("inside")
    )
    running = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = per_step.select(
        "step",
        F.sum("outside").over(running).alias("tp"),
        F.sum("inside").over(running).alias("fp"),
        (F.sum("outside").over(everything) - F.sum("outside").over(running)).alias("fn"),
        (F.sum("inside").over(everything) - F.sum("inside").over(running)).alias("tn"),
    ).where(F.col("step") <= steps)
    scored = _scores(counts)
    best = Window.orderBy(F.desc("f2"), F.desc("answer_rate"), F.asc("step"))
    threshold = F.round(F.lit(low) + F.lit(high - low) * F.col("step") / steps, 6)
    return scored.withColumn("threshold", threshold).withColumn("best", F.row_number().over(best) == 1)


def live_data_cases(judged: DataFrame, threshold: float = V.REFUSAL_THRESHOLD) -> DataFrame:
    return judged.where("live_data").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") < threshold).alias("would_refuse")
    )


# --- grounding ---------------------------------------------------------------------------------------


def grounding_claims(answers: DataFrame, cited: DataFrame, key: Sequence[str]) -> DataFrame:
    """Claims of each answer with the share of their terms that the cited passages contain.

    `answers`: key, answer. `cited`: key, text. Returns key, claim_no, n_terms, n_covered, supported.
    """
    key = list(key)
    label = r"\[" + V.CITATION_LABEL + r"\]"
    said = F.transform(X.sentences(F.regexp_replace("answer", label, "")), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    claims = answers.select(*key, F.posexplode(said).alias("claim_no", "claim"))
    claims = claims.where(F.length("claim") >= V.GROUNDING_MIN_SENTENCE)
    claims = claims.select(*key, "claim_no", X.term_set(F.col("claim"), V.GROUNDING_STOPWORDS, V.GROUNDING_MIN_TERM).alias("terms"))
    terms = claims.select(*key, "claim_no", F.explode("terms").alias("term"))
    source = cited.select(*key, F.explode(X.term_set(F.col("text"), V.GROUNDING_STOPWORDS, V.GROUNDING_MIN_TERM)).alias("term"))
    known = source.distinct().withColumn("known", F.lit(1))
    counted = terms.join(known, [*key, "term"], "left").groupBy(*key, "claim_no").agg(
        F.count("*").alias("n_terms"), F.count("known").alias("n_covered")
    )
    return counted.withColumn("supported", F.col("n_covered") / F.col("n_terms") >= V.GROUNDING_COVERAGE)


def grounding_summary(results: DataFrame, *dims: str) -> DataFrame:
    """Answered, refused, claims, supported, grounded rate and share with citations, per `dims`.

    `results`: refused, n_claims, n_supported, has_citations (and optionally fell_back, lexical).
    """
    answered = ~F.col("refused")
    claims = F.sum(F.when(answered, F.col("n_claims")).otherwise(0))
    supported = F.sum(F.when(answered, F.col("n_supported")).otherwise(0))
    measures = [
        F.count("*").alias("n_questions"),
        F.count_if(answered).alias("n_answered"),
        F.count_if("refused").alias("n_refused"),
        claims.alias("total_claims"),
        supported.alias("supported_claims"),
        F.round(ratio(supported, claims), 4).alias("grounded_rate"),
        F.round(ratio(F.count_if(answered & F.col("has_citations")), F.count_if(answered)), 4).alias("citation_rate"),
    ]
    for flag, name in (("fell_back", "n_fell_back"), ("lexical", "n_lexical")):
        if flag in results.columns:
            measures.append(F.count_if(answered & F.col(flag)).alias(name))
    return results.groupBy(*dims).agg(*measures)


def grounding_by_depth(results: DataFrame) -> DataFrame:
    """Summary per explanation depth with the rate's distance from the concise depth."""
    summary = grounding_summary(results, "depth")
    base = F.max(F.when(F.col("depth") == "concise", F.col("grounded_rate"))).over(Window.partitionBy(F.lit(1)))
    return summary.withColumn("delta", F.round(F.col("grounded_rate") - base, 4))


def looks_like_refusal(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for phrase in V.REFUSAL_PHRASES:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


def system_compare(results: DataFrame) -> DataFrame:
    """Answered, refused, citation and grounded rates per system."""
    answered = ~F.col("refused")
    claims, supported = F.sum("n_claims"), F.sum("n_supported")
    return results.groupBy("system").agg(
        F.count("*").alias("n"),
        F.count_if(answered).alias("answered"),
        F.count_if("refused").alias("refused_n"),
        F.round(ratio(F.count_if("refused"), F.count("*")), 4).alias("refusal_rate"),
        F.round(ratio(F.count_if(answered & F.col("has_citations")), F.count_if(answered)), 4).alias("citation_rate"),
        F.round(ratio(supported, claims), 4).alias("grounded_rate"),
    )


# --- logs ------------------------------------------------------------------------------------------


def run_log_stats(runs: DataFrame, latest: int = V.RUN_LOG_ROWS) -> DataFrame:
    """Counts and the upper median latency of each user's latest runs."""
    recent = top_rows(runs, ["user_id"], [F.desc("ran_at"), F.desc("run_id")], latest, "age")
    by_latency = Window.partitionBy("user_id").orderBy("latency_ms", "run_id")
    size = F.count("*").over(Window.partitionBy("user_id"))
    placed = recent.withColumns({"place": F.row_number().over(by_latency), "n": size})
    return placed.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("refused")).alias("answered"),
        F.count_if("refused").alias("refused_n"),
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("latency_ms"))).alias("median_latency"),
    )


def stage_profile(timings: DataFrame) -> DataFrame:
    """Seconds and share of the total per stage, over groups already summed per stage."""
    per_stage = timings.groupBy("stage").agg(F.sum(F.col("seconds").cast("decimal(38,6)")).cast("double").alias("seconds"))
    total = F.sum("seconds").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per_stage.withColumn("share", F.round(F.col("seconds") / total, 4))


def eval_history(runs: DataFrame, schema: str) -> DataFrame:
    """Stored runs, oldest first, with their metrics decoded from JSON."""
    return runs.withColumn("metrics", F.from_json("metrics", schema)).orderBy("ran_at", "run_id")
