"""Evaluation queries: gold labels, retrieval metrics, refusal calibration, grounding, logs."""

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as X
from lectern.operators import evaluation as E
from lectern.operators import retrieval as R
from lectern.plans import retrieval as PR
from lectern.plans import sqltext as S
from lectern.plans.registry import query

KEY = ["user_id", "q_id"]

# --- gold ---------------------------------------------------------------------------------

SPANS = """spans AS (SELECT q.user_id, q.q_id, c.source_id, c.page_start AS page_lo, c.page_end AS page_hi
    FROM questions_v q JOIN chunks_v c ON c.user_id = q.user_id AND contains(c.text, q.q))"""


def gold_spans(t):
    pages = t("chunks_v").select("user_id", "chunk_id", "source_id", F.col("page_start").alias("page_lo"), F.col("page_end").alias("page_hi"))
    return PR.gold_of(t).join(pages, ["user_id", "chunk_id"]).select(*KEY, "source_id", "page_lo", "page_hi")


@query("gold_interval_join", f"""WITH {SPANS} SELECT s.user_id, s.q_id, s.source_id, c.chunk_id, s.page_lo, s.page_hi, c.page_start, c.page_end
    FROM spans s JOIN chunks_v c ON c.user_id = s.user_id AND c.source_id = s.source_id AND c.page_start <= s.page_hi AND c.page_end >= s.page_lo""")
def gold_interval_join(t):
    return E.gold_interval_join(gold_spans(t), t("chunks_v"))


LABELLED = """labelled AS (SELECT user_id, CASE WHEN q_id % 7 = 0 THEN 0 ELSE q_id END AS q_id, q_id % 3 <> 0 AS in_corpus, slice FROM questions_v)"""
SPANS2 = """spans2 AS (SELECT user_id, q_id, CASE WHEN q_id % 5 <> 0 THEN 'src' || (q_id % 25) END AS source_id, q_id % 150 AS page_lo, q_id % 150 + 1 AS page_hi FROM questions_v)"""


def labelled(t):
    return t("questions_v").selectExpr("user_id", "CASE WHEN q_id % 7 = 0 THEN 0 ELSE q_id END AS q_id", "q_id % 3 <> 0 AS in_corpus", "slice")


@query("gold_validate", f"""WITH {LABELLED}, {SPANS2},
    resolved AS (SELECT DISTINCT s.user_id, s.q_id FROM spans2 s JOIN chunks_v c ON c.user_id = s.user_id AND c.source_id = s.source_id AND c.page_start <= s.page_hi AND c.page_end >= s.page_lo)
    SELECT user_id, q_id, 'duplicate id' AS problem FROM labelled GROUP BY ALL HAVING COUNT(*) > 1
    UNION ALL SELECT DISTINCT user_id, q_id, 'in corpus without gold' FROM labelled l WHERE in_corpus AND NOT EXISTS (SELECT 1 FROM spans2 s WHERE s.user_id = l.user_id AND s.q_id = l.q_id AND s.source_id IS NOT NULL)
    UNION ALL SELECT DISTINCT user_id, q_id, 'gold span matches nothing' FROM spans2 s WHERE s.source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.user_id = s.user_id AND r.q_id = s.q_id)""")
def gold_validate(t):
    # every fifth question has a label row that names no source
    spans = t("questions_v").selectExpr(
        "user_id", "q_id", "CASE WHEN q_id % 5 <> 0 THEN concat('src', q_id % 25) END AS source_id", "q_id % 150 AS page_lo", "q_id % 150 + 1 AS page_hi"
    )
    return E.gold_validate(labelled(t), spans, E.gold_interval_join(spans, t("chunks_v")))


@query("slice_rollup", f"""WITH {LABELLED} SELECT coalesce(slice, 'total') AS slice, COUNT(*) AS n, COUNT(*) FILTER (in_corpus) AS in_corpus,
    COUNT(*) FILTER (NOT in_corpus) AS outside FROM labelled GROUP BY ROLLUP (slice)""")
def slice_rollup(t):
    return E.slice_rollup(labelled(t))


# --- metrics --------------------------------------------------------------------------------

DCG = S.exact_sum("1.0 / log2(rank + 2)")


def metrics_sql(ranked: str, dims: str = "", name: str = "metrics") -> str:
    d = f"{dims}, " if dims else ""
    return f"""{name}_size AS (SELECT user_id, q_id, slice, COUNT(*) AS n_gold FROM gold GROUP BY ALL),
{name}_hit AS (SELECT {d}r.user_id, r.q_id, MIN(rank) + 1 AS best, {DCG} AS dcg FROM {ranked} r JOIN gold g USING (user_id, q_id, chunk_id) WHERE rank < 10 GROUP BY ALL)"""


METRIC_COLUMNS = """CASE WHEN h.best <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS r1, CASE WHEN h.best <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS r3,
    CASE WHEN h.best <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS r5, CASE WHEN h.best <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS r10,
    coalesce(round(1.0::DOUBLE / h.best, 6), 0.0) AS mrr,
    coalesce(round(h.dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1.0 / log2(i + 1))), 6), 0.0) AS ndcg10"""
METRICS = f"""{metrics_sql('sparse')}, metrics AS (SELECT s.user_id, s.q_id, s.slice, {METRIC_COLUMNS} FROM metrics_size s LEFT JOIN metrics_hit h USING (user_id, q_id))"""
MEANS = ", ".join(f"round({S.exact_sum(m)} / COUNT(*), 4) AS {m}" for m in E.METRICS)


@query("ir_metrics", f"WITH {PR.SPARSE}, {S.GOLD}, {METRICS} SELECT * FROM metrics")
def ir_metrics(t):
    return E.ir_metrics(PR.sparse_lists(t), PR.gold_of(t), KEY)


@query("ir_metrics_rollup", f"""WITH {PR.SPARSE}, {S.GOLD}, {METRICS}
    SELECT coalesce(slice, 'all') AS slice, COUNT(*) AS n, {MEANS} FROM metrics GROUP BY ROLLUP (slice)""")
def ir_metrics_rollup(t):
    return E.ir_metrics_rollup(ir_metrics(t), "slice")


@query("ir_misses", f"""WITH {S.DENSE}, {S.GOLD} SELECT DISTINCT user_id, q_id FROM gold g
    WHERE NOT EXISTS (SELECT 1 FROM dense d JOIN gold g2 USING (user_id, q_id, chunk_id) WHERE d.rank < 10 AND d.user_id = g.user_id AND d.q_id = g.q_id)""")
def ir_misses(t):
    return E.ir_misses(PR.dense_lists(t), PR.gold_of(t), KEY)


@query("first_gold_rank", f"""WITH {PR.FUSED}, {S.GOLD} SELECT g.user_id, g.q_id, MIN(f.fused_rank) + 1 AS first_rank
    FROM gold g LEFT JOIN fused f USING (user_id, q_id, chunk_id) GROUP BY ALL""")
def first_gold_rank(t):
    fused = PR.fused_lists(t).withColumnRenamed("fused_rank", "rank")
    out = E.first_gold_rank(fused, PR.gold_of(t), KEY)
    return out.withColumn("first_rank", F.col("first_rank").cast("long"))


# the questions, two thirds of them with the framing of a compound question around the text
POSED = """posed_v AS (SELECT user_id, q_id, slice, CASE WHEN q_id % 3 = 0 THEN q WHEN q_id % 3 = 1 THEN concat(q, '? Give me an example')
      ELSE concat(q, '? How does it play into the real world?') END AS q FROM questions_v)"""


def ladder_sql() -> str:
    """CTEs up to rungs (config, user_id, q_id, chunk_id, rank): every configuration over sparse and dense lists of the posed questions.

    Whole questions are searched under sub_no -1, parsed ones under the numbers of their sub-queries.
    """
    flags = ", ".join(
        f"({S.literal(name)}, {r.use_dense}, {r.use_sparse}, {r.decompose}, {r.use_rerank and r.rerank_mode == 'rank'}, {r.title_boost}::DOUBLE)" for name, r in R.LADDER
    )
    return f"""{POSED}, {S.INDEX}, {PR.DECOMPOSE.replace('phrased_v', 'posed_v')},
parts AS (SELECT s.* FROM subs s JOIN judged j USING (user_id, q_id) WHERE s.n_subs > 1 AND NOT j.single),
used AS (SELECT user_id, q_id, -1 AS sub_no, q, 1.0::DOUBLE AS weight, NULL::VARCHAR AS want_course, NULL::BIGINT AS want_chapter FROM posed_v
  UNION ALL SELECT p.user_id, p.q_id, coalesce(s.sub_no, 0), coalesce(s.sub, p.q), coalesce(s.weight, 1.0::DOUBLE), NULL, NULL FROM posed_v p LEFT JOIN parts s USING (user_id, q_id)),
{S.bm25('used', 'q_id, sub_no')}, {S.encoded_lists()},
configs(config, use_dense, use_sparse, decompose, reorder, boost) AS (VALUES {flags}),
lists AS (SELECT user_id, q_id, sub_no, chunk_id, rank, 'sparse' AS kind FROM sparse UNION ALL SELECT user_id, q_id, sub_no, chunk_id, rank, 'dense' FROM dense),
mix AS (SELECT config, user_id, q_id, chunk_id, round({S.exact_sum(f"weight / ({V.RRF_K} + rank + 1)")}, 8) AS rrf_score
  FROM lists JOIN used USING (user_id, q_id, sub_no) JOIN configs ON decompose = (sub_no >= 0) AND CASE kind WHEN 'dense' THEN use_dense ELSE use_sparse END GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, user_id, q_id ORDER BY rrf_score DESC, chunk_id) - 1 AS fused_rank FROM mix) WHERE fused_rank < {V.FUSED_TOP_K}),
cand AS (SELECT DISTINCT user_id, q_id, chunk_id FROM fused), {PR.rerank_sql('cand', 'posed_v')},
titled AS (SELECT f.*, c.reorder, c.boost, r.rerank_score, {S.title_tokens("CASE WHEN c.decompose AND j.concept <> '' THEN j.concept ELSE p.q END")} AS qt, {S.title_tokens('k.chapter_title')} AS ct
  FROM fused f JOIN configs c USING (config) JOIN reranked r USING (user_id, q_id, chunk_id) JOIN posed_v p USING (user_id, q_id)
  JOIN judged j USING (user_id, q_id) JOIN chunks_v k USING (user_id, chunk_id)),
rungs AS (SELECT config, user_id, q_id, chunk_id, row_number() OVER (PARTITION BY config, user_id, q_id
    ORDER BY round(CASE WHEN reorder THEN rerank_score ELSE rrf_score END + boost * {S.set_similarity('qt', 'ct')}, 6) DESC, fused_rank) - 1 AS rank FROM titled)"""


@query("ablation", f"""WITH {ladder_sql()}, {S.GOLD},
    {metrics_sql('rungs', 'config')},
    metrics AS (SELECT c.config, s.slice, {METRIC_COLUMNS} FROM metrics_size s, configs c
                LEFT JOIN metrics_hit h ON h.user_id = s.user_id AND h.q_id = s.q_id AND h.config = c.config)
    SELECT config, coalesce(slice, 'all') AS slice, COUNT(*) AS n, {MEANS} FROM metrics GROUP BY GROUPING SETS ((config, slice), (config))""")
def ablation(t):
    """Metrics of all eight rungs of the ladder, the configuration as a dimension."""
    frame = F.when(F.col("q_id") % 3 == 0, "").when(F.col("q_id") % 3 == 1, "? Give me an example").otherwise("? How does it play into the real world?")
    posed = t("questions_v").withColumn("q", F.concat("q", frame))
    ranked = R.ablation_ladder(posed, t("chunks_v"), PR.index_of(t, stored=True), R.build_dense_index(t("chunks_v")))
    configs = F.explode(F.array(*[F.lit(name) for name, _ in R.LADDER])).alias("config")
    gold = PR.gold_of(t).select(configs, "*")
    return E.ir_metrics_rollup(E.ir_metrics(ranked, gold, ["config", *KEY]), "config", "slice")


# --- refusal ------------------------------------------------------------------------------------

# a question belongs to the corpus when one of its tenant's chunks contains it
JUDGED = f"""{PR.CONFIDENCE}, {S.GOLD},
judged AS (SELECT c.user_id, c.q_id, c.confidence, EXISTS (SELECT 1 FROM gold g WHERE g.user_id = c.user_id AND g.q_id = c.q_id) AS in_corpus,
           c.q_id % 10 = 3 AS live_data, c.q_id % 8 = 5 AS gated FROM conf c)"""


def judged(t):
    inside = PR.gold_of(t).select(*KEY).distinct().withColumn("in_corpus", F.lit(True))
    out = PR.confidences(t).join(inside, KEY, "left")
    return out.select(
        *KEY, "confidence", F.coalesce("in_corpus", F.lit(False)).alias("in_corpus"),
        (F.col("q_id") % 10 == 3).alias("live_data"), (F.col("q_id") % 8 == 5).alias("gated"),
    )


def score_sql(counts: str) -> str:
    def f_beta(b2):
        return f"CASE WHEN {b2} * p + r <> 0 THEN (1 + {b2}) * p * r / ({b2} * p + r) ELSE 0 END::DOUBLE"

    return f"""(SELECT *, CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn <> 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r,
      CASE WHEN tn + fp <> 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS ar FROM {counts})""", (
        f"round(p, 4) AS precision, round(r, 4) AS recall, round({f_beta('1.0')}, 4) AS f1, round({f_beta('4.0')}, 4) AS f2, round(ar, 4) AS answer_rate"
    )


_inner, _outer = score_sql("counts")


@query("refusal_scores", f"""WITH {JUDGED},
    s AS (SELECT *, confidence < {V.REFUSAL_THRESHOLD} OR (gate AND gated) AS refused FROM judged, (SELECT UNNEST([true, false]) AS gate) WHERE NOT live_data),
    counts AS (SELECT gate, COUNT(*) FILTER (NOT in_corpus AND refused) AS tp, COUNT(*) FILTER (in_corpus AND refused) AS fp,
               COUNT(*) FILTER (NOT in_corpus AND NOT refused) AS fn, COUNT(*) FILTER (in_corpus AND NOT refused) AS tn FROM s GROUP BY gate)
    SELECT gate, tp, fp, fn, tn, {_outer} FROM {_inner}""")
def refusal_scores(t):
    return E.refusal_scores(judged(t))


@query("threshold_sweep", f"""WITH {JUDGED},
    s AS (SELECT *, confidence < 0.02 + {0.95 - 0.02!r} * step / 94 OR gated AS refused FROM judged, (SELECT UNNEST(range(0, 95)) AS step) WHERE NOT live_data),
    counts AS (SELECT step, COUNT(*) FILTER (NOT in_corpus AND refused) AS tp, COUNT(*) FILTER (in_corpus AND refused) AS fp,
               COUNT(*) FILTER (NOT in_corpus AND NOT refused) AS fn, COUNT(*) FILTER (in_corpus AND NOT refused) AS tn FROM s GROUP BY step),
    out AS (SELECT step, tp, fp, fn, tn, {_outer} FROM {_inner})
    SELECT *, round(0.02 + {0.95 - 0.02!r} * step / 94, 6) AS threshold, row_number() OVER (ORDER BY f2 DESC, answer_rate DESC, step) = 1 AS best FROM out""")
def threshold_sweep(t):
    return E.threshold_sweep(judged(t)).withColumn("step", F.col("step").cast("long"))


@query("live_data_cases", f"WITH {JUDGED} SELECT COUNT(*) AS n, COUNT(*) FILTER (confidence < {V.REFUSAL_THRESHOLD}) AS would_refuse FROM judged WHERE live_data")
def live_data_cases(t):
    return E.live_data_cases(judged(t))


# --- grounding: each assistant turn answers, the earlier user turns of the conversation are cited -------

ANSWERS = """answers AS (SELECT conv_id, turn, text || ' [en, Ch 3, pp. 4-5] ' || text AS answer FROM conversations WHERE role = 'assistant'),
cited AS (SELECT a.conv_id, a.turn, c.text FROM answers a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.turn)"""
LABEL = r"\[" + V.CITATION_LABEL + r"\]"
CLAIMS = f"""{ANSWERS},
said AS (SELECT conv_id, turn, list_transform({S.sentences(f"regexp_replace(answer, {S.literal(LABEL)}, '', 'g')")}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS ss FROM answers),
claims AS (SELECT conv_id, turn, UNNEST(ss) AS claim, generate_subscripts(ss, 1) - 1 AS claim_no FROM said),
terms AS (SELECT conv_id, turn, claim_no, UNNEST({S.term_set('claim', V.GROUNDING_STOPWORDS, V.GROUNDING_MIN_TERM)}) AS term FROM claims WHERE length(claim) >= {V.GROUNDING_MIN_SENTENCE}),
known AS (SELECT DISTINCT conv_id, turn, term FROM (SELECT conv_id, turn, UNNEST({S.term_set('text', V.GROUNDING_STOPWORDS, V.GROUNDING_MIN_TERM)}) AS term FROM cited)),
grounded AS (SELECT t.conv_id, t.turn, t.claim_no, COUNT(*) AS n_terms, COUNT(k.term) AS n_covered, COUNT(k.term)::DOUBLE / COUNT(*) >= {V.GROUNDING_COVERAGE} AS supported
             FROM terms t LEFT JOIN known k ON k.conv_id = t.conv_id AND k.turn = t.turn AND k.term = t.term GROUP BY ALL)"""


def grounded(t):
    c = t("conversations")
    answers = c.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat("text", F.lit(" [en, Ch 3, pp. 4-5] "), "text").alias("answer")
    )
    earlier = c.select("conv_id", F.col("turn").alias("said_at"), "text")
    cited = answers.select("conv_id", "turn").join(earlier, "conv_id").where("said_at < turn")
    return E.grounding_claims(answers, cited.select("conv_id", "turn", "text"), ["conv_id", "turn"])


@query("grounding_claims", f"WITH {CLAIMS} SELECT * FROM grounded")
def grounding_claims(t):
    return grounded(t).withColumn("claim_no", F.col("claim_no").cast("long"))


ANSWER_ROWS = f"""{CLAIMS}, per_answer AS (SELECT conv_id, turn, COUNT(*) AS n_claims, COUNT(*) FILTER (supported) AS n_supported FROM grounded GROUP BY ALL),
results AS (SELECT c.conv_id, c.turn, CASE WHEN c.conv_id % 3 = 0 THEN 'in_depth' ELSE 'concise' END AS depth, CASE WHEN c.turn % 4 = 1 THEN 'bare' ELSE 'system' END AS system,
      c.conv_id % 5 = 0 AS refused, coalesce(p.n_claims, 0) AS n_claims, coalesce(p.n_supported, 0) AS n_supported, c.conv_id % 4 <> 0 AS has_citations,
      c.conv_id % 7 = 0 AS fell_back, c.turn % 3 = 0 AS lexical
    FROM conversations c LEFT JOIN per_answer p USING (conv_id, turn) WHERE c.role = 'assistant')"""


def answer_rows(t):
    per_answer = grounded(t).groupBy("conv_id", "turn").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))
    rows = t("conversations").where("role = 'assistant'").join(per_answer, ["conv_id", "turn"], "left")
    return rows.selectExpr(
        "conv_id", "turn", "CASE WHEN conv_id % 3 = 0 THEN 'in_depth' ELSE 'concise' END AS depth",
        "CASE WHEN turn % 4 = 1 THEN 'bare' ELSE 'system' END AS system", "conv_id % 5 = 0 AS refused",
        "coalesce(n_claims, 0) AS n_claims", "coalesce(n_supported, 0) AS n_supported",
        "conv_id % 4 <> 0 AS has_citations", "conv_id % 7 = 0 AS fell_back", "turn % 3 = 0 AS lexical",
    )


SUMMARY = """COUNT(*) AS n_questions, COUNT(*) FILTER (NOT refused) AS n_answered, COUNT(*) FILTER (refused) AS n_refused,
    CAST(SUM(CASE WHEN refused THEN 0 ELSE n_claims END) AS BIGINT) AS total_claims, CAST(SUM(CASE WHEN refused THEN 0 ELSE n_supported END) AS BIGINT) AS supported_claims,
    round(CASE WHEN SUM(CASE WHEN refused THEN 0 ELSE n_claims END) <> 0 THEN SUM(CASE WHEN refused THEN 0 ELSE n_supported END)::DOUBLE / SUM(CASE WHEN refused THEN 0 ELSE n_claims END) ELSE 0 END, 4) AS grounded_rate,
    round(CASE WHEN COUNT(*) FILTER (NOT refused) <> 0 THEN COUNT(*) FILTER (NOT refused AND has_citations)::DOUBLE / COUNT(*) FILTER (NOT refused) ELSE 0 END, 4) AS citation_rate,
    COUNT(*) FILTER (NOT refused AND fell_back) AS n_fell_back, COUNT(*) FILTER (NOT refused AND lexical) AS n_lexical"""


@query("grounding_summary", f"WITH {ANSWER_ROWS} SELECT {SUMMARY} FROM results")
def grounding_summary(t):
    return E.grounding_summary(answer_rows(t))


@query("grounding_by_depth", f"""WITH {ANSWER_ROWS}, s AS (SELECT depth, {SUMMARY} FROM results GROUP BY depth)
    SELECT *, round(grounded_rate - (SELECT grounded_rate FROM s WHERE depth = 'concise'), 4) AS delta FROM s""")
def grounding_by_depth(t):
    return E.grounding_by_depth(answer_rows(t))


REFUSES = " OR ".join(f"contains(lower(text), {S.literal(p)})" for p in V.REFUSAL_PHRASES)


@query("system_compare", f"""WITH {ANSWER_ROWS}, phrased AS (SELECT r.* EXCLUDE (refused), ({REFUSES}) AS refused FROM results r JOIN
        (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'Sorry, I cannot answer: ' || text ELSE text END AS text FROM conversations) c USING (conv_id, turn))
    SELECT system, COUNT(*) AS n, COUNT(*) FILTER (NOT refused) AS answered, COUNT(*) FILTER (refused) AS refused_n,
      round(COUNT(*) FILTER (refused)::DOUBLE / COUNT(*), 4) AS refusal_rate,
      round(CASE WHEN COUNT(*) FILTER (NOT refused) <> 0 THEN COUNT(*) FILTER (NOT refused AND has_citations)::DOUBLE / COUNT(*) FILTER (NOT refused) ELSE 0 END, 4) AS citation_rate,
      round(CASE WHEN SUM(n_claims) <> 0 THEN SUM(n_supported)::DOUBLE / SUM(n_claims) ELSE 0 END, 4) AS grounded_rate
    FROM phrased GROUP BY system""")
def system_compare(t):
    said = t("conversations").selectExpr("conv_id", "turn", "CASE WHEN conv_id % 5 = 0 THEN concat('Sorry, I cannot answer: ', text) ELSE text END AS said")
    rows = answer_rows(t).drop("refused").join(said, ["conv_id", "turn"])
    return E.system_compare(rows.withColumn("refused", E.looks_like_refusal(F.col("said"))))


@query("link_compare", f"""WITH t AS (SELECT chunk_id, {S.mentions("'Ch. ' || (chunk_id % 23) || ' ' || text")}[1] AS by_number, CASE WHEN chunk_id % 4 <> 0 THEN chapter_num END AS by_meaning FROM chunks_v)
    SELECT COUNT(*) AS n_rows, COUNT(by_meaning) AS meaning_linked, COUNT(by_number) AS number_linked, COUNT(*) FILTER (by_meaning = by_number) AS agree,
           COUNT(*) FILTER (by_meaning IS NOT NULL AND by_number IS NULL) AS only_meaning, COUNT(*) FILTER (by_meaning IS NULL AND by_number IS NOT NULL) AS only_number FROM t""")
def link_compare(t):
    """Agreement of two link outputs, matched on the row id by a full join."""
    from lectern.operators.syllabus import link_compare

    c = t("chunks_v")
    said = F.concat(F.lit("Ch. "), (F.col("chunk_id") % 23).cast("string"), F.lit(" "), "text")
    number = c.select(F.col("chunk_id").alias("row_id"), F.try_element_at(X.chapter_mentions(said), F.lit(1)).cast("long").alias("link"))
    meaning = c.select(F.col("chunk_id").alias("row_id"), F.when(F.col("chunk_id") % 4 != 0, F.col("chapter_num")).alias("link"))
    return link_compare(meaning, number)


# --- logs ---------------------------------------------------------------------------------------------


@query("run_log_stats", """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ran_at DESC, run_id DESC) AS age FROM runs_v) WHERE age <= 100),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latency_ms, run_id) AS place, COUNT(*) OVER (PARTITION BY user_id) AS n FROM recent)
    SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (NOT refused) AS answered, COUNT(*) FILTER (refused) AS refused_n, MAX(CASE WHEN place = n // 2 + 1 THEN latency_ms END) AS median_latency FROM placed GROUP BY user_id""")
def run_log_stats(t):
    return E.run_log_stats(t("runs_v"))


@query("stage_profile", """WITH s AS (SELECT event_type AS stage, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS seconds FROM events GROUP BY event_type)
    SELECT stage, seconds, round(seconds / (SELECT CAST(SUM(CAST(seconds AS DECIMAL(38,6))) AS DOUBLE) FROM s), 4) AS share FROM s""")
def stage_profile(t):
    return E.stage_profile(t("events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("eval_history", """SELECT event_id AS run_id, CAST(ts AS VARCHAR) AS ran_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def eval_history(t):
    runs = t("events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("ran_at"), F.col("props").alias("metrics"))
    out = E.eval_history(runs, "k BIGINT")
    return out.select("run_id", F.col("ran_at").cast("string").alias("ran_at"), "metrics.k")
