"""Temperature mixing of sources: exponent by bisection, weights realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import store

#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: The entropy that the weights reach at least, as a share of that of equal weights.
ENTROPY_SHARE = 0.98
#: A source is not repeated more often than this.
MAX_REPEATS = 4.0
#: Blocks of a source, 16 to the power 3: whole blocks are drawn until the budget ends inside one.
BLOCK_DIGITS = 3
SEED = "mix-1"
#: Bits of the exponent, found some at a time: each job over the source totals tries 2^6 - 1 inner points.
BITS_PER_JOB, JOBS = 6, 5


def temperature(totals: DataFrame, entropy_share: float, max_repeats: float, budget_share: float) -> float:
    """The exponent in [0, 1] for the source totals in column `tokens`.

    Entropy falls and repetition falls as the exponent grows. The result is the largest exponent whose entropy is
    at least `entropy_share` of the maximum, or, if that repeats a source too often, the smallest one within
    `max_repeats`; 1 if no exponent is. Only sums over sources leave the executors, whatever the number of sources.
    """
    positive = totals.where("tokens > 0")
    stats = positive.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not stats["n"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(stats["t"]))
    least, goal = stats["least"] / stats["t"], entropy_share * math.log(stats["n"])

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent."""
        sums = [c for p in points for c in (F.sum(F.pow(share, F.lit(p))), F.sum(F.pow(share, F.lit(p)) * F.ln(share)))]
        row = positive.agg(*sums).first()
        out = []
        for k, p in enumerate(points):
            z, m = row[2 * k], row[2 * k + 1]
            out.append((math.log(z) - p * m / z, least ** (p - 1) / z * budget_share))
        return out

    def cut(good) -> tuple[float, float]:
        """Neighbouring points of the finest grid: `good` holds at the first and not at the second."""
        low, width = 0.0, 1.0
        for _ in range(JOBS):
            width /= 2**BITS_PER_JOB
            points = [low + width * k for k in range(1, 2**BITS_PER_JOB)]
            low += width * sum(good(h, r) for h, r in measured(points))
        return low, low + width

    ends = measured([0.0, 1.0])
    by_entropy = 1.0 if ends[1][0] >= goal else cut(lambda h, _: h >= goal)[0]
    if ends[0][1] <= max_repeats:
        by_repeats = 0.0
    elif ends[1][1] > max_repeats:
        by_repeats = 1.0
    else:
        by_repeats = cut(lambda _, r: r > max_repeats)[1]
    return max(by_entropy, by_repeats)


def keyed(*parts: Column) -> Column:
    """A keyed order: md5 over the parts; a null part counts as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def mix_sources(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None,
    entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, seed: str = SEED, block_digits: int = BLOCK_DIGITS,
) -> DataFrame:
    """Draw documents so that the sources meet temperature-scaled weights within a token budget.

    Source weights are token shares to the power of an exponent (see `temperature`), normalised. A source gets
    floor(budget x weight) tokens; `budget` is by default the number of tokens of all documents. Each source is
    drawn in whole passes, then in a part of a pass: blocks in the keyed order of that pass while they fit, then
    documents of the next block in keyed order while they fit. Reading a source's rows by (epoch, block_key,
    doc_key) is a keyed permutation of each pass.

    Returns `key`, source, n_tokens, epoch (0 for the first pass), block, block_key, doc_key; a row for each draw.
    Null is a source of its own. A null or empty text has no tokens and is drawn with its block at no cost; a source
    without any tokens has no weight and is not drawn. Repeated rows are documents of their own; with equal keys
    they tie and are interchangeable. An empty table gives an empty table. Other columns are not read.

    Block totals are summed before they are shuffled and there are at most 16^`block_digits` a source; the only
    ordered pass over documents is inside the one block of a source where its budget ends.
    """
    head = F.substring(keyed(F.lit(seed), F.col(key)), 1, block_digits)
    rows = docs.select(
        F.col(key).alias(key), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"), head.alias("block"),
    )
    rows = store(rows, "mix-rows")
    blocks = store(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = whole if budget is None else budget
    exponent = temperature(totals, entropy_share, max_repeats, budget / whole if whole else 1.0)

    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(whole, 1))), F.lit(exponent)))
    norm = totals.agg(F.coalesce(F.sum(raw), F.lit(1.0))).first()[0]
    # a sum of doubles depends on its order in the last bits, which must not cost a whole token where the share is exact
    due = F.floor(F.round(F.lit(float(budget)) * raw / F.lit(norm), 6)).cast("long")
    passes = totals.where("tokens > 0").select(
        F.col("source").alias("_s"), F.expr("tokens").alias("_t"), due.alias("_due")
    ).select("_s", F.floor(F.col("_due") / F.col("_t")).cast("int").alias("passes"), (F.col("_due") % F.col("_t")).alias("rest"))

    order = keyed(F.lit(seed), F.col("source"), F.col("passes"), F.col("block"))
    planned = blocks.join(passes, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    so_far = W.partitionBy("source").orderBy("_order", "block").rowsBetween(W.unboundedPreceding, -1)
    planned = planned.withColumn("_order", order).withColumn("_before", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)))
    left = F.col("rest") - F.col("_before")
    planned = planned.select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), "passes",
        F.when(left >= F.col("tokens"), "whole").when(left > 0, "part").otherwise("none").alias("fate"),
        F.greatest(left, F.lit(0)).alias("room"),
    )
    drawn = rows.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "inner").drop("_s", "_b")
    last_key = keyed(F.lit(seed), F.col("passes"), F.col(key))
    inside = W.partitionBy("source", "block").orderBy("_last", key).rowsBetween(W.unboundedPreceding, 0)
    part = drawn.where("fate = 'part'").withColumn("_last", last_key)
    part = part.withColumn("extra", (F.sum("n_tokens").over(inside) <= F.col("room")).cast("int")).drop("_last")
    rest = drawn.where("fate <> 'part'").withColumn("extra", (F.col("fate") == "whole").cast("int"))
    copies = part.unionByName(rest).withColumn("times", F.col("passes") + F.col("extra")).where("times > 0")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return copies.select(
        key, "source", "n_tokens", "epoch", "block",
        keyed(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")).alias("block_key"),
        keyed(F.lit(seed), F.col("epoch"), F.col(key)).alias("doc_key"),
    )


def mix_sources_sql(documents: str = "documents") -> str:
    """`mix_sources` with its default parameters for DuckDB; the bisection is one halving a step here."""
    bits = BITS_PER_JOB * JOBS
    step = 2.0**-bits
    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, COALESCE(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n_tokens,
         substr(md5('{SEED}:' || COALESCE(doc_id::VARCHAR, '')), 1, {BLOCK_DIGITS}) AS block
  FROM {documents}),
blocks AS (SELECT source, block, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM blocks GROUP BY ALL),
whole AS (SELECT COALESCE(sum(tokens), 0)::DOUBLE AS t FROM totals),
shares AS (SELECT list(tokens / (SELECT t FROM whole)) AS p FROM totals WHERE tokens > 0),
limits AS (SELECT p, {ENTROPY_SHARE} * ln(len(p)) AS goal, list_min(p) AS least FROM shares),
measure AS (SELECT p, goal, least,
    -list_sum(list_transform(p, lambda x: x * ln(x))) >= goal AS flat_enough,
    1.0 / (least * len(p)) <= {MAX_REPEATS} AS few_repeats, 1.0 > {MAX_REPEATS} AS never FROM limits),
-- the widths of the halvings, both searches side by side
search(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1,
    CASE WHEN (SELECT ln(list_sum(list_transform(p, lambda x: pow(x, a + pow(2.0, -(k + 1)))))) - (a + pow(2.0, -(k + 1)))
                 * list_sum(list_transform(p, lambda x: pow(x, a + pow(2.0, -(k + 1))) * ln(x)))
                 / list_sum(list_transform(p, lambda x: pow(x, a + pow(2.0, -(k + 1))))) >= goal FROM limits)
         THEN a + pow(2.0, -(k + 1)) ELSE a END,
    CASE WHEN (SELECT pow(least, b + pow(2.0, -(k + 1)) - 1) / list_sum(list_transform(p, lambda x: pow(x, b + pow(2.0, -(k + 1))))) > {MAX_REPEATS} FROM limits)
         THEN b + pow(2.0, -(k + 1)) ELSE b END
  FROM search WHERE k < {bits}),
exponent AS (SELECT greatest(CASE WHEN flat_enough THEN 1.0 ELSE a END,
                             CASE WHEN few_repeats THEN 0.0 WHEN never THEN 1.0 ELSE b + {step!r} END) AS e
             FROM search, measure WHERE k = {bits}),
weights AS (SELECT source, tokens, pow(tokens / t, e) AS w, t FROM totals, whole, exponent WHERE tokens > 0),
due AS (SELECT source, tokens, floor(round(t * w / (SELECT sum(w) FROM weights), 6))::BIGINT AS due FROM weights),
passes AS (SELECT source AS s, (due // tokens)::INTEGER AS passes, due % tokens AS rest FROM due),
planned AS (
  SELECT source, block, tokens, passes, rest, COALESCE(sum(tokens) OVER (PARTITION BY source
      ORDER BY md5('{SEED}:' || COALESCE(source, '') || ':' || passes || ':' || block), block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM blocks JOIN passes ON source IS NOT DISTINCT FROM s),
drawn AS (
  SELECT r.doc_id, r.source, r.n_tokens, r.block, p.passes, p.rest - p.before_ AS left_, p.tokens,
         sum(r.n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY md5('{SEED}:' || p.passes || ':' || COALESCE(r.doc_id::VARCHAR, '')), r.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows_ r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source AND r.block = p.block),
copies AS (
  SELECT *, unnest(range(0, passes + CASE WHEN left_ >= tokens THEN 1 WHEN left_ > 0 AND upto <= left_ THEN 1 ELSE 0 END))::INTEGER AS epoch
  FROM drawn)
SELECT doc_id, source, n_tokens, epoch, block,
       md5('{SEED}:' || COALESCE(source, '') || ':' || epoch || ':' || block) AS block_key,
       md5('{SEED}:' || epoch || ':' || COALESCE(doc_id::VARCHAR, '')) AS doc_key
FROM copies"""
