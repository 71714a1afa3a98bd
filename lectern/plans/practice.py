"""Practice queries over parts (problems), line items (attempts, answers) and documents (raw problems)."""

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.operators import practice as PR
from lectern.plans import sqltext as S
from lectern.plans.ingest import strip_sql
from lectern.plans.registry import query


@query("practice_queue", """WITH h AS (SELECT user_id, problem_id, COUNT(*) AS n_attempts, COUNT(*) FILTER (NOT correct) AS misses FROM attempts_v GROUP BY ALL),
    j AS (SELECT p.user_id, p.problem_id, p.origin, p.number, coalesce(n_attempts, 0) AS n_attempts, coalesce(misses, 0) AS misses FROM problems_v p LEFT JOIN h USING (user_id, problem_id))
    SELECT user_id, problem_id, n_attempts, misses, CASE WHEN origin = 'uploaded' THEN 2 ELSE 3 END AS max_help,
      row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN misses = 0 THEN 1 ELSE 0 END, misses DESC, CASE WHEN origin <> 'uploaded' THEN 1 ELSE 0 END, number, problem_id) AS place FROM j""")
def practice_queue(t):
    out = PR.practice_queue(t("problems_v"), t("attempts_v"))
    return out.select("user_id", "problem_id", "n_attempts", "misses", "max_help", F.col("place").cast("long").alias("place"))


@query("test_assembly", f"""WITH ex AS (SELECT DISTINCT a.user_id, r.chapter_ref FROM assessments_v a JOIN schedule_refs_v r USING (id) WHERE a.kind IN ({S.quoted(V.EXAM_KINDS)}) AND a.due >= DATE '2001-01-01')
    SELECT user_id, problem_id, covered, place FROM (SELECT p.user_id, p.problem_id, e.chapter_ref IS NOT NULL AS covered,
      row_number() OVER (PARTITION BY p.user_id ORDER BY e.chapter_ref IS NOT NULL DESC, p.problem_id) - 1 AS place FROM problems_v p LEFT JOIN ex e USING (user_id, chapter_ref) WHERE origin = 'generated' AND verified) WHERE place < 8""")
def test_assembly(t):
    exams = t("assessments_v").where(F.col("kind").isin(V.EXAM_KINDS) & (F.col("due") >= "2001-01-01"))
    refs = exams.select("id", "user_id").join(t("schedule_refs_v"), "id")
    out = PR.assemble_test(t("problems_v"), refs)
    return out.select("user_id", "problem_id", "covered", F.col("place").cast("long").alias("place"))


@query("attempt_credit", """SELECT p.user_id, p.chapter_ref, COUNT(*) AS ps_hits, CAST(SUM(greatest(0, least(3, a.help_level))) AS BIGINT) AS help_total
    FROM attempts_v a JOIN problems_v p USING (user_id, problem_id) WHERE p.chapter_ref <> '' GROUP BY ALL""")
def attempt_credit(t):
    return PR.attempt_credit(t("attempts_v"), t("problems_v"))


def _pairs(x: str) -> str:
    p = S.literal(V.ANSWER_PAIR)
    return f"list_transform(list_zip(regexp_extract_all(coalesce({x}, ''), {p}, 1), regexp_extract_all(coalesce({x}, ''), {p}, 2)), lambda z: {{'n': z[1], 'v': z[2]::DOUBLE}})"


_LAST = "list_filter({0}, lambda y: y.n = x)[-1].v"
_CLOSE = f"abs({_LAST.format('have')} - {_LAST.format('want')}) <= greatest({V.GRADE_REL_TOL} * greatest(abs({_LAST.format('have')}), abs({_LAST.format('want')})), {V.GRADE_ABS_TOL})"


@query("grade_answers", f"""WITH p AS (SELECT test_id, {_pairs('expected')} AS want, {_pairs('entered')} AS have FROM answers_v),
    g AS (SELECT test_id, len(want) > 0 AND len(list_filter(list_distinct(list_transform(want, lambda w: w.n)), lambda x: NOT coalesce({_CLOSE}, false))) = 0 AS correct FROM p)
    SELECT test_id, COUNT(*) FILTER (correct) AS score, COUNT(*) AS total, CAST(round_even(100.0::DOUBLE * COUNT(*) FILTER (correct) / COUNT(*), 0) AS BIGINT) AS percent FROM g GROUP BY test_id""")
def grade_answers(t):
    return PR.test_score(PR.grade_answers(t("answers_v")), "test_id")


LABELS = {
    "cobb_douglas_utility_max": ("x1", "x2"), "budget_line": ("x1_intercept", "x2_intercept"), "price_elasticity": ("quantity", "elasticity"),
    "profit_max_monopoly": ("quantity", "price"), "cost_minimization": ("L", "K"),
}
_NEAR = "coalesce(abs({c} - ({v})) <= greatest(0.001 * greatest(abs({c}), abs({v})), 0.000001) OR abs({c} - ({v})) <= 0.001 * greatest(1.0, abs({c}), abs({v})), false)"
_K = "power(q / power(a * r / (b * w), a), 1 / (a + b))"
_TRUTHS = {
    "cobb_douglas_utility_max": ("a * m / ((a + b) * p1)", "b * m / ((a + b) * p2)"),
    "budget_line": ("m / p1", "m / p2"),
    "price_elasticity": ("qa - qb * p0", "-qb * p0 / (qa - qb * p0)"),
    "profit_max_monopoly": ("(qa - c) / (2 * qb)", "qa - (qa - c) / 2"),
    "cost_minimization": (f"{_K} * a * r / (b * w)", _K),
}
# the third answer of three templates is claimed from the same row, exactly
_CHECKS = " ".join(
    f"WHEN template = '{name}' THEN {_NEAR.format(c='claim1', v=a)} AND {_NEAR.format(c='claim2', v=b)}" for name, (a, b) in _TRUTHS.items()
)


@query("verify_keys", f"""WITH k AS (SELECT *, CASE {_CHECKS} ELSE false END AS ok FROM keyed_v)
    SELECT id, template, type, CASE WHEN template <> 'none' AND ok THEN 'verified' WHEN template <> 'none' THEN 'discarded' WHEN type IN ('numeric', 'symbolic') THEN 'discarded' ELSE 'unverified' END AS route FROM k""")
def verify_keys(t):
    """Problems built from line items; some claims are off by two percent, some parameters missing."""
    return keyed(t).select("id", "template", "type", "route")


def keyed(t):
    k = t("keyed_v")
    names = {"a": "a", "b": "b", "m": "m", "p1": "p1", "p2": "p2", "A": "qa", "B": "qb", "P0": "p0", "c": "c", "w": "w", "r": "r", "Q": "q"}
    params = F.create_map(*[x for name, column in names.items() for x in (F.lit(name), F.col(column).cast("double"))])
    claimed = None
    for template, (one, two) in LABELS.items():
        # the remaining answer of a template follows from the other two
        extra = {
            "budget_line": ("slope", -F.col("p1") / F.col("p2")),
            "profit_max_monopoly": ("profit", (F.col("claim2") - F.col("c")) * (F.col("qa") - F.col("c")) / (2 * F.col("qb"))),
            "cost_minimization": ("cost", F.col("w") * F.col("claim2") * F.col("a") * F.col("r") / (F.col("b") * F.col("w")) + F.col("r") * F.col("claim2")),
        }.get(template)
        pairs = [F.lit(one), F.col("claim1").cast("double"), F.lit(two), F.col("claim2").cast("double")]
        if extra:
            pairs += [F.lit(extra[0]), extra[1].cast("double")]
        value = F.create_map(*pairs)
        claimed = F.when(F.col("template") == template, value) if claimed is None else claimed.when(F.col("template") == template, value)
    return PR.verify_keys(k.withColumns({"params": params, "claimed": claimed}))


def _text(x: str, default: str = "") -> str:
    return strip_sql(f"coalesce({x}, '{default}')")


_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PROBLEM_TYPE_ALIASES.items())
_KIND = f"CASE lower({_text('type', 'short_answer')}) {_ALIAS} ELSE replace(lower({_text('type', 'short_answer')}), '-', '_') END"
_CONF = "coalesce(try_cast(confidence AS DOUBLE), 0.5)"


@query("problem_normalise", f"""SELECT doc_id, source_id, substr({_text('number')}, 1, 12) AS number, md5({_text('prompt')}) AS prompt_hash, CASE WHEN {_KIND} IN ({S.quoted(V.PROBLEM_TYPES)}) THEN {_KIND} ELSE 'short_answer' END AS type,
    substr({_text('topic')}, 1, 80) AS topic, lower({_text('difficulty', 'standard')}) AS difficulty, {_text('given_solution')} AS given_solution, {_CONF} AS confidence, {_CONF} < {V.PROBLEM_CONFIDENCE_FLOOR} AS needs_review
    FROM raw_problems_v WHERE {_text('prompt')} <> ''""")
def problem_normalise(t):
    out = PR.problem_normalise(t("raw_problems_v"))
    return out.withColumn("prompt_hash", F.md5(F.col("prompt").cast("binary"))).drop("prompt")


@query("practice_import_report", f"""WITH g AS (SELECT id % 50 AS source_no, CASE WHEN template <> 'none' AND ok THEN 'verified' WHEN template <> 'none' OR type IN ('numeric', 'symbolic') THEN 'discarded' ELSE 'unverified' END AS route
        FROM (SELECT *, CASE {_CHECKS} ELSE false END AS ok FROM keyed_v)),
    a AS (SELECT source_no, 'generated' AS origin, route, false AS needs_review FROM g UNION ALL SELECT doc_id % 50, 'uploaded', NULL, {_CONF} < {V.PROBLEM_CONFIDENCE_FLOOR} FROM raw_problems_v WHERE {_text('prompt')} <> '')
    SELECT source_no, COUNT(*) FILTER (origin = 'uploaded') AS parsed, COUNT(*) FILTER (origin = 'uploaded' AND needs_review) AS to_review, COUNT(*) FILTER (route = 'verified') AS kept,
      COUNT(*) FILTER (route = 'discarded') AS discarded, COUNT(*) FILTER (route = 'unverified') AS unverified,
      round(CASE WHEN COUNT(*) FILTER (origin = 'generated') <> 0 THEN COUNT(*) FILTER (route = 'discarded')::DOUBLE / COUNT(*) FILTER (origin = 'generated') ELSE 0 END, 3) AS discard_rate FROM a GROUP BY source_no""")
def practice_import_report(t):
    generated = keyed(t).select((F.col("id") % 50).alias("source_no"), F.lit("generated").alias("origin"), "route", F.lit(False).alias("needs_review"))
    parsed = PR.problem_normalise(t("raw_problems_v"))
    uploaded = parsed.select((F.col("doc_id") % 50).alias("source_no"), F.lit("uploaded").alias("origin"), F.lit(None).cast("string").alias("route"), "needs_review")
    return PR.import_report(generated.unionByName(uploaded), "source_no")


@query("practice_link", f"""WITH ch AS (SELECT user_id, course_id, source_id, chapter_num, arg_min(chapter_title, ordinal) AS title FROM chunks_v WHERE chapter_num <> 0 GROUP BY ALL),
    c AS (SELECT *, {S.tokens('title')} AS ta, {S.title_tokens('title')} AS tw FROM ch),
    q AS (SELECT user_id, course_id, chunk_id AS problem_id, {S.tokens("chapter_title || ' ' || substr(text, 1, 120)")} AS qa, {S.title_tokens("chapter_title || ' ' || substr(text, 1, 120)")} AS qw FROM chunks_v),
    g AS (SELECT {S.tokens(S.literal(V.GENERIC_CHAPTER_TERMS))} AS ga),
    p AS (SELECT q.user_id, q.problem_id, q.course_id, c.source_id, c.chapter_num, round({S.set_similarity('q.qw', 'c.tw')}, 6) AS score FROM q JOIN c USING (user_id, course_id), g
          WHERE len(list_filter(list_intersect(q.qa, c.ta), lambda w: NOT list_contains(g.ga, w))) > 0),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, problem_id ORDER BY score DESC, source_id, chapter_num) AS n FROM p WHERE score >= {V.PRACTICE_LINK_FLOOR}) WHERE n = 1)
    SELECT q.user_id, q.problem_id, b.course_id || ':' || b.source_id || ':' || b.chapter_num AS chapter_ref, b.score FROM q LEFT JOIN b USING (user_id, problem_id)""")
def practice_link(t):
    problems = t("chunks_v").selectExpr("user_id", "course_id", "chunk_id AS problem_id", "chapter_title AS topic", "text AS prompt")
    chapters = t("chunks_v").where("chapter_num <> 0").groupBy("user_id", "course_id", "source_id", "chapter_num").agg(F.min_by("chapter_title", "ordinal").alias("title"))
    return PR.practice_link(problems, chapters)


_PARTS = f"list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"


@query("help_gate", f"""SELECT doc_id, least(CASE WHEN origin = 'uploaded' THEN 2 ELSE 3 END, greatest(1, least(3, level))) AS granted, level > CASE WHEN origin = 'uploaded' THEN 2 ELSE 3 END AS blocked,
    array_to_string(list_filter({_PARTS}, lambda s: s <> '' AND NOT regexp_matches(s, {S.literal(V.HELP_ARITHMETIC)}) AND NOT regexp_matches(s, {S.literal('(?i)' + V.HELP_CONCLUSION)})), ' ') AS method FROM help_requests_v""")
def help_gate(t):
    return PR.help_gate(t("help_requests_v")).select("doc_id", "granted", "blocked", "method")
