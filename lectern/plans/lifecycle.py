"""Lifecycle queries over the tables of all tenants."""

from pyspark.sql import functions as F

from lectern.operators import lifecycle as K
from lectern.plans.registry import query

NAMES = (
    "sources chunks chapters parents schedule assessments calendar_events grade_records task_status study_plans problems "
    "attempts engagement manual_progress conversations messages artifacts ingest_jobs agent_runs"
).split()


def tables_of(t):
    return {name: t(f"del_{name}_v") for name in NAMES}


_BASE = """SELECT id, user_id, title, due, status, weight FROM {assessments_v}"""
_UPDATES = """SELECT event_id % 4000 AS id, concat('u', event_id % 4000 % 20) AS user_id, CASE WHEN event_id % 2 = 0 THEN concat('New ', event_id) END AS title, CAST(NULL AS DATE) AS due,
    CASE WHEN event_id % 3 = 0 THEN 'done' END AS status, 0.75 AS weight, event_id FROM {events}"""


def _sql(text):
    return text.replace("{", "").replace("}", "")


@query("upsert_latest", f"""WITH b AS ({_sql(_BASE)}), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, user_id ORDER BY event_id DESC) AS n FROM ({_sql(_UPDATES)})) WHERE n = 1)
    SELECT id, user_id, CASE WHEN u.n = 1 THEN u.title ELSE b.title END AS title, CAST(CASE WHEN u.n = 1 THEN u.due ELSE b.due END AS VARCHAR) AS due, CASE WHEN u.n = 1 THEN u.status ELSE b.status END AS status, CAST(CASE WHEN b.id IS NOT NULL THEN b.weight ELSE u.weight END AS DOUBLE) AS weight FROM b FULL JOIN u USING (id, user_id)""")
def upsert_latest(t):
    base = t.spark.sql(_BASE, assessments_v=t("assessments_v")).withColumn("weight", F.col("weight").cast("double"))
    updates = t.spark.sql(_UPDATES, events=t("events")).withColumn("weight", F.col("weight").cast("double"))
    out = K.upsert_latest(base, updates, ["id", "user_id"], "event_id", preserved=["weight"])
    return out.withColumn("due", F.col("due").cast("string"))


_PROBLEMS = """SELECT user_id, problem_id AS id, concat('s', problem_id % 9) AS source_id, CASE WHEN origin = 'generated' THEN problem_id - problem_id % 3 END AS parent_id, origin FROM {problems_v}"""
_FRESH = """SELECT user_id, problem_id + 1000000 AS id, 's4' AS source_id, CAST(NULL AS BIGINT) AS parent_id, 'uploaded' AS origin FROM {problems_v} WHERE origin = 'uploaded'"""


@query("replace_source", f"""WITH p AS ({_sql(_PROBLEMS)}), n AS ({_sql(_FRESH)}), s AS (SELECT DISTINCT user_id, source_id FROM n),
    gone AS (SELECT p.user_id, p.id FROM p JOIN s USING (user_id, source_id))
    SELECT user_id, id, source_id, parent_id, origin FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.source_id = p.source_id) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = p.user_id AND g.id = p.parent_id)
    UNION ALL SELECT * FROM n""")
def replace_source(t):
    problems = t.spark.sql(_PROBLEMS, problems_v=t("problems_v"))
    return K.replace_source(problems, t.spark.sql(_FRESH, problems_v=t("problems_v")))


@query("ttl_filter", "SELECT run_id, user_id FROM runs_v WHERE epoch(date_trunc('second', TIMESTAMP '2024-01-20 00:00:00')) - epoch(date_trunc('second', ran_at)) <= CASE WHEN run_id % 2 = 0 THEN 86400 ELSE 604800 END")
def ttl_filter(t):
    cache = t("runs_v").withColumn("fetched_at", F.col("ran_at"))
    ttl = F.when(F.col("run_id") % 2 == 0, 86400).otherwise(604800)
    return K.ttl_filter(cache, F.to_timestamp(F.lit("2024-01-20 00:00:00")), ttl).select("run_id", "user_id")


_SRC_OK = """((r.scope = 'materials' AND s.type IN ('textbook', 'slides', 'notes', 'bbplus')) OR (r.scope = 'syllabus' AND (s.type = 'syllabus' OR regexp_matches(lower(s.file), 'syllabus|course_outline|course-outline|syll')))
    OR (r.scope = 'assessment_uploads' AND s.type = 'assessment') OR r.scope = 'entire_course')"""
_K = "r.user_id, r.course_id, r.scope"
_J = "JOIN req r ON r.user_id = x.user_id AND r.course_id = x.course_id"
OWNED = f"""req AS (SELECT * FROM del_requests_v WHERE user_id <> 'benchmark'),
src AS (SELECT {_K}, s.source_id FROM del_sources_v s JOIN req r ON r.user_id = s.user_id AND r.course_id = s.course_id WHERE {_SRC_OK}),
o1 AS (
  SELECT user_id, course_id, scope, 'sources' AS tab, source_id AS row_id FROM src
  UNION SELECT {_K}, 'chunks', CAST(x.row_id AS VARCHAR) FROM del_chunks_v x {_J} WHERE r.scope = 'entire_course' OR (r.scope IN ('materials', 'syllabus') AND (r.user_id, r.course_id, r.scope, x.source_id) IN (SELECT user_id, course_id, scope, source_id FROM src))
  UNION SELECT {_K}, 'chapters', x.row_id FROM del_chapters_v x {_J} WHERE r.scope = 'entire_course' OR (r.scope IN ('materials', 'syllabus') AND (r.user_id, r.course_id, r.scope, x.source_id) IN (SELECT user_id, course_id, scope, source_id FROM src))
  UNION SELECT {_K}, 'schedule', CAST(x.row_id AS VARCHAR) FROM del_schedule_v x {_J} WHERE r.scope IN ('syllabus', 'entire_course')
  UNION SELECT {_K}, 'assessments', CAST(x.row_id AS VARCHAR) FROM del_assessments_v x {_J} WHERE r.scope IN ('syllabus', 'entire_course')
  UNION SELECT {_K}, 'calendar_events', CAST(x.row_id AS VARCHAR) FROM del_calendar_events_v x {_J} WHERE r.scope = 'entire_course' OR (r.scope = 'syllabus' AND x.notes = 'from syllabus')
  UNION SELECT {_K}, 'grade_records', x.row_id FROM del_grade_records_v x {_J} WHERE r.scope IN ('syllabus', 'entire_course')
  UNION SELECT {_K}, 'problems', CAST(x.row_id AS VARCHAR) FROM del_problems_v x {_J} WHERE r.scope IN ('assessment_uploads', 'entire_course')
  UNION SELECT {_K}, 'conversations', CAST(x.row_id AS VARCHAR) FROM del_conversations_v x {_J} WHERE r.scope = 'entire_course'
  UNION SELECT {_K}, 'ingest_jobs', CAST(x.row_id AS VARCHAR) FROM del_ingest_jobs_v x {_J} WHERE r.scope = 'entire_course'
  UNION SELECT {_K}, 'agent_runs', CAST(x.row_id AS VARCHAR) FROM del_agent_runs_v x {_J} WHERE r.scope = 'entire_course'
  UNION SELECT {_K}, 'engagement', x.row_id FROM del_engagement_v x JOIN req r ON r.user_id = x.user_id AND starts_with(x.chapter_ref, r.course_id || ':') WHERE r.scope = 'entire_course'
  UNION SELECT {_K}, 'manual_progress', x.row_id FROM del_manual_progress_v x JOIN req r ON r.user_id = x.user_id AND starts_with(x.chapter_ref, r.course_id || ':') WHERE r.scope = 'entire_course'),
psrc AS (SELECT * FROM src UNION SELECT {_K}, x.source_id FROM (SELECT user_id, course_id, source_id FROM del_chunks_v UNION SELECT user_id, course_id, source_id FROM del_chapters_v UNION SELECT user_id, course_id, source_id FROM del_problems_v) x {_J} WHERE r.scope = 'entire_course'),
ticked AS (SELECT user_id, course_id, scope, CASE tab WHEN 'schedule' THEN 'sched:' WHEN 'assessments' THEN 'assess:' ELSE 'event:' END || row_id AS item FROM o1 WHERE tab IN ('schedule', 'calendar_events') OR (tab = 'assessments' AND scope = 'entire_course')),
o2 AS (SELECT user_id, course_id, scope, tab, row_id FROM o1
  UNION SELECT p.user_id, p.course_id, p.scope, 'parents', x.row_id FROM del_parents_v x JOIN psrc p ON p.user_id = x.user_id AND p.source_id = x.source_id
  UNION SELECT i.user_id, i.course_id, i.scope, 'task_status', x.row_id FROM del_task_status_v x JOIN ticked i ON i.user_id = x.user_id AND i.item = split_part(x.row_id, ':', 1) || ':' || split_part(x.row_id, ':', 2)
  UNION SELECT a.user_id, a.course_id, a.scope, 'study_plans', CAST(x.row_id AS VARCHAR) FROM del_study_plans_v x JOIN o1 a ON a.tab = 'assessments' AND a.user_id = x.user_id AND a.row_id = CAST(x.assessment_id AS VARCHAR)
  UNION SELECT a.user_id, a.course_id, a.scope, 'attempts', x.row_id FROM del_attempts_v x JOIN o1 a ON a.tab = 'problems' AND a.user_id = x.user_id AND a.row_id = CAST(x.problem_id AS VARCHAR)
  UNION SELECT {_K}, 'attempts', x.row_id FROM del_attempts_v x JOIN req r ON r.user_id = x.user_id AND starts_with(x.chapter_ref, r.course_id || ':') WHERE r.scope IN ('assessment_uploads', 'entire_course')
  UNION SELECT c.user_id, c.course_id, c.scope, 'messages', x.row_id FROM del_messages_v x JOIN o1 c ON c.tab = 'conversations' AND c.user_id = x.user_id AND c.row_id = CAST(x.conversation_id AS VARCHAR)
  UNION SELECT c.user_id, c.course_id, c.scope, 'artifacts', x.row_id || '.a' FROM del_messages_v x JOIN o1 c ON c.tab = 'conversations' AND c.user_id = x.user_id AND c.row_id = CAST(x.conversation_id AS VARCHAR))"""


@query("delete_preview", f"WITH {OWNED} SELECT user_id, course_id, scope, tab AS \"table\", COUNT(*) AS n_rows FROM o2 GROUP BY ALL")
def delete_preview(t):
    return K.delete_preview(tables_of(t), t("del_requests_v"))


SURVIVORS = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", user_id, COUNT(*) AS n_rows FROM del_{n}_v x WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.tab = '{n}' AND o2.user_id = x.user_id AND o2.row_id = CAST(x.row_id AS VARCHAR)) GROUP BY user_id"
    for n in NAMES
)


@query("delete_cascade", f"WITH {OWNED} {SURVIVORS}")
def delete_cascade(t):
    """Rows left per table and tenant after all requests."""
    out = None
    for name, df in K.delete_cascade(tables_of(t), t("del_requests_v")).items():
        left = df.groupBy("user_id").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "user_id", "n_rows")
        out = left if out is None else out.unionByName(left)
    return out


LINKS = [("messages", "conversation_id", "conversations"), ("attempts", "problem_id", "problems"), ("study_plans", "assessment_id", "assessments"), ("chunks", "source_id", "sources")]


def _audit_sql(child, column, parent):
    return (
        f"SELECT '{child}' AS child, '{parent}' AS parent, COUNT(*) AS orphans, COUNT(*) FILTER (CAST({column} AS VARCHAR) IN (SELECT CAST(row_id AS VARCHAR) FROM del_{parent}_v)) AS foreign_rows "
        f"FROM del_{child}_v c WHERE NOT EXISTS (SELECT 1 FROM del_{parent}_v p WHERE p.user_id = c.user_id AND CAST(p.row_id AS VARCHAR) = CAST(c.{column} AS VARCHAR))"
    )


@query("tenant_audit", " UNION ALL ".join(_audit_sql(*link) for link in LINKS))
def tenant_audit(t):
    return K.tenant_audit(tables_of(t), LINKS)


@query("orphan_audit", """SELECT user_id, problem_id, row_id, CAST(problem_id AS VARCHAR) IN (SELECT CAST(row_id AS VARCHAR) FROM del_problems_v) AS "foreign" FROM del_attempts_v c
    WHERE NOT EXISTS (SELECT 1 FROM del_problems_v p WHERE p.user_id = c.user_id AND p.row_id = c.problem_id)""")
def orphan_audit(t):
    return K.orphan_audit(t("del_attempts_v").drop("chapter_ref"), t("del_problems_v"), "problem_id", "row_id")
