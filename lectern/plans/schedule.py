"""Dashboard and calendar queries for all users as of one date."""

from datetime import date

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.operators import schedule as H
from lectern.plans import sqltext as S
from lectern.plans.registry import query
from lectern.sources.tables import AS_OF

TODAY = date.fromisoformat(AS_OF)
D = f"DATE '{AS_OF}'"


def counters_of(t):
    return H.engagement_counters(t("engagement_ev_v"))


def manual_of(t):
    return H.manual_latest(t("manual_v"))


def users_of(t):
    return t("schedule_v").select("user_id").distinct()


def text_date(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


COUNTERS = """counters AS (SELECT user_id, chapter_ref, COUNT(*) FILTER (kind = 'question') AS questions, COUNT(*) FILTER (kind = 'ps_hit') AS ps_hits, COUNT(*) FILTER (kind = 'export') AS exports, MAX(ts) AS last_touched
    FROM engagement_ev_v WHERE kind IN ('question', 'ps_hit', 'export') GROUP BY ALL),
scored AS (SELECT *, least(1.0, (questions + 2.0 * ps_hits + 1.5 * exports) / 10.0)::DOUBLE AS score FROM counters)"""
MANUAL = """manual AS (SELECT user_id, chapter_ref, greatest(0.0, least(1.0, arg_max(progress, (ts, event_id)))) AS progress FROM manual_v GROUP BY ALL)"""
STATUS = "CASE WHEN {0} >= 0.6 THEN 'engaged' WHEN {0} > 0 THEN 'partial' ELSE 'none' END"


@query("engagement_counters", f"WITH {COUNTERS} SELECT user_id, chapter_ref, questions, ps_hits, exports, CAST(CAST(last_touched AS DATE) AS VARCHAR) AS last_day FROM counters")
def engagement_counters(t):
    return counters_of(t).withColumn("last_day", F.col("last_touched").cast("date").cast("string")).drop("last_touched")


@query("engagement_score", f"WITH {COUNTERS} SELECT user_id, chapter_ref, round(score, 4) AS score, {STATUS.format('score')} AS status FROM scored")
def engagement_score(t):
    return H.scored_engagement(counters_of(t)).select("user_id", "chapter_ref", F.round("score", 4).alias("score"), "status")


@query("manual_latest", f"WITH {MANUAL} SELECT user_id, chapter_ref, round(progress, 6) AS progress FROM manual")
def manual_latest(t):
    return manual_of(t).withColumn("progress", F.round("progress", 6))


def ready_sql(refs: str) -> str:
    return f"""{COUNTERS}, {MANUAL}, labels AS (SELECT user_id, source_id, chapter_num, arg_min(chapter_title, ordinal) AS title FROM library_v WHERE chapter_title <> '' GROUP BY ALL),
wanted AS (SELECT DISTINCT user_id, chapter_ref, split_part(chapter_ref, ':', 1) AS course_id, split_part(chapter_ref, ':', 2) AS source_id, coalesce(try_cast(split_part(chapter_ref, ':', 3) AS BIGINT), 0) AS chapter_num FROM {refs}),
ready0 AS (SELECT w.user_id, w.chapter_ref, w.course_id, w.chapter_num, coalesce(l.title, 'Ch ' || w.chapter_num) AS label, round(coalesce(s.score, 0.0), 3) AS derived, round(m.progress, 3) AS manual,
      coalesce(s.questions, 0) AS questions, coalesce(s.ps_hits, 0) AS ps_hits, coalesce(s.exports, 0) AS exports, l.title IS NOT NULL AS has_materials
    FROM wanted w LEFT JOIN scored s USING (user_id, chapter_ref) LEFT JOIN manual m USING (user_id, chapter_ref) LEFT JOIN labels l ON l.user_id = w.user_id AND l.source_id = w.source_id AND l.chapter_num = w.chapter_num),
ready AS (SELECT *, {STATUS.format('derived')} AS status FROM ready0)"""


@query("chapter_readiness", f"WITH sr AS (SELECT s.user_id, r.chapter_ref FROM schedule_v s JOIN schedule_refs_v r USING (id)), {ready_sql('sr')} SELECT * FROM ready")
def chapter_readiness(t):
    refs = t("schedule_v").select("id", "user_id").join(t("schedule_refs_v"), "id")
    return H.chapter_readiness(refs, counters_of(t), manual_of(t), t("library_v"))


@query("engagement_report", f"WITH lr AS (SELECT user_id, course_id || ':' || source_id || ':' || chapter_num AS chapter_ref FROM library_v), {ready_sql('lr')} SELECT * FROM ready")
def engagement_report(t):
    return H.engagement_report(t("library_v"), counters_of(t), manual_of(t))


# --- ranges and exams ------------------------------------------------------------------------


@query("schedule_range", f"SELECT id, user_id, CAST(due AS VARCHAR) AS due, kind FROM schedule_v WHERE due >= {D} - 30 AND due <= {D} + 120")
def schedule_range(t):
    from datetime import timedelta

    out = H.schedule_range(t("schedule_v"), TODAY - timedelta(days=30), TODAY + timedelta(days=120))
    return text_date(out.select("id", "user_id", "due", "kind"), "due")


@query("schedule_undated", "SELECT id, user_id, course_id, kind, topic FROM schedule_v WHERE due IS NULL")
def schedule_undated(t):
    return t("schedule_v").where("due IS NULL").select("id", "user_id", "course_id", "kind", "topic")


NEXT = f"""nexts AS (SELECT user_id, id, course_id, topic, due, CAST(due - {D} AS INTEGER) AS days_away FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, id) AS n FROM schedule_v WHERE kind = 'exam' AND due >= {D}) WHERE n = 1)"""


@query("next_exam", f"WITH {NEXT} SELECT user_id, id, course_id, topic, CAST(due AS VARCHAR) AS due, days_away FROM nexts")
def next_exam(t):
    return text_date(H.next_exam(t("schedule_v"), TODAY), "due")


EXAM = f"{NEXT}, covered AS (SELECT n.user_id, n.id, n.days_away, r.chapter_ref FROM nexts n JOIN schedule_refs_v r USING (id)), {ready_sql('covered')}, ec AS (SELECT c.id, c.days_away, r.* FROM covered c JOIN ready r USING (user_id, chapter_ref))"


def chapters_of_exams(t):
    exams = H.next_exam(t("schedule_v"), TODAY)
    return exams, H.exam_chapters(exams, t("schedule_refs_v"), counters_of(t), manual_of(t), t("library_v"))


@query("exam_readiness", f"""WITH {EXAM} SELECT n.user_id, n.id, n.course_id, n.topic, CAST(n.due AS VARCHAR) AS due, n.days_away, COUNT(e.id) AS n_chapters, coalesce(round({S.exact_sum('e.derived')} / COUNT(e.id), 3), 0.0) AS overall
    FROM nexts n LEFT JOIN ec e ON e.user_id = n.user_id AND e.id = n.id GROUP BY ALL""")
def exam_readiness(t):
    return text_date(H.exam_readiness(*chapters_of_exams(t)), "due")


@query("study_plan", f"""WITH {EXAM}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY derived, questions DESC, course_id, chapter_num, chapter_ref) - 1 AS place, COUNT(*) OVER (PARTITION BY user_id, id) AS n FROM ec WHERE days_away > 0),
    q AS (SELECT *, CAST(place // greatest(1, CAST(ceil(n::DOUBLE / greatest(1, greatest(1, least(days_away, 10)) - 1)) AS BIGINT)) + 1 AS INTEGER) AS day FROM p)
    SELECT user_id, id, day, greatest(1, days_away - day + 1) AS days_before_exam, chapter_ref, status, CASE WHEN derived = 0 THEN 'no engagement' ELSE 'needs review' END AS reason,
      CASE WHEN day = MAX(day) OVER (PARTITION BY user_id, id) THEN 'lighter load: review only' ELSE '' END AS note FROM q""")
def study_plan(t):
    return H.study_plan(chapters_of_exams(t)[1])


# --- week, upcoming, pace ------------------------------------------------------------------------


@query("week_view", f"""WITH {COUNTERS}, days AS (SELECT user_id, UNNEST(generate_series(date_trunc('week', {D})::TIMESTAMP, date_trunc('week', {D})::TIMESTAMP + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM schedule_v)),
    items AS (SELECT user_id, due AS day, COUNT(*) AS n_items FROM schedule_v GROUP BY ALL),
    cov AS (SELECT DISTINCT s.user_id, s.due AS day, r.chapter_ref FROM schedule_v s JOIN schedule_refs_v r USING (id)),
    eng AS (SELECT c.user_id, c.day, COUNT(*) AS n_chapters, round({S.exact_sum('coalesce(s.score, 0.0)')} / COUNT(*), 3) AS engagement FROM cov c LEFT JOIN scored s USING (user_id, chapter_ref) GROUP BY ALL)
    SELECT d.user_id, CAST(d.day AS VARCHAR) AS day, strftime(d.day, '%a') AS weekday, d.day = {D} AS is_today, coalesce(n_items, 0) AS n_items, coalesce(n_chapters, 0) AS n_chapters, engagement
    FROM days d LEFT JOIN items i ON i.user_id = d.user_id AND i.day = d.day LEFT JOIN eng e ON e.user_id = d.user_id AND e.day = d.day""")
def week_view(t):
    out = H.week_view(users_of(t), t("schedule_v"), t("schedule_refs_v"), counters_of(t), TODAY)
    return text_date(out, "day")


@query("upcoming_top8", f"""SELECT user_id, id, CAST(due AS VARCHAR) AS due, kind, topic, CAST(due - {D} AS INTEGER) AS days_away FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, id) AS n
    FROM schedule_v WHERE due BETWEEN {D} + 1 AND {D} + 21 AND kind IN ('exam', 'due')) WHERE n <= 8""")
def upcoming_top8(t):
    out = H.upcoming(t("schedule_v"), TODAY)
    return text_date(out.select("user_id", "id", "due", "kind", "topic", "days_away"), "due")


PACE = f"""{COUNTERS}, lec AS (SELECT * FROM schedule_v WHERE kind = 'lecture'),
pace AS (SELECT user_id, course_id, COUNT(*) AS meetings_total, COUNT(*) FILTER (coalesce(due <= {D}, false)) AS meetings_to_date FROM lec GROUP BY ALL),
topics AS (SELECT DISTINCT l.user_id, l.course_id, r.chapter_ref FROM lec l JOIN schedule_refs_v r USING (id) WHERE l.due <= {D}),
eng AS (SELECT t.user_id, t.course_id, COUNT(*) AS topics_to_date, COUNT(*) FILTER (coalesce(s.score >= 0.3, false)) AS topics_engaged FROM topics t LEFT JOIN scored s USING (user_id, chapter_ref) GROUP BY ALL),
report AS (SELECT p.*, coalesce(topics_to_date, 0) AS topics_to_date, coalesce(topics_engaged, 0) AS topics_engaged FROM pace p LEFT JOIN eng USING (user_id, course_id))"""
RATES = """round(CASE WHEN meetings_total <> 0 THEN meetings_to_date::DOUBLE / meetings_total ELSE 0 END, 4) AS pace, round(CASE WHEN topics_to_date <> 0 THEN topics_engaged::DOUBLE / topics_to_date ELSE 0 END, 4) AS progress,
    greatest(0, topics_to_date - topics_engaged) AS behind"""


def report_of(t):
    return H.progress_report(t("schedule_v"), t("schedule_refs_v"), counters_of(t), TODAY)


@query("progress_report", f"WITH {PACE} SELECT *, {RATES} FROM report")
def progress_report(t):
    return report_of(t)


@query("progress_rollup", f"""WITH {PACE}, sums AS (SELECT user_id, CAST(SUM(meetings_total) AS BIGINT) AS meetings_total, CAST(SUM(meetings_to_date) AS BIGINT) AS meetings_to_date,
    CAST(SUM(topics_to_date) AS BIGINT) AS topics_to_date, CAST(SUM(topics_engaged) AS BIGINT) AS topics_engaged FROM report GROUP BY user_id) SELECT *, {RATES} FROM sums""")
def progress_rollup(t):
    return H.progress_rollup(report_of(t))


# --- calendar ------------------------------------------------------------------------------------------


def expand_sql(lo: str, hi: str, source: str = "calendar_events_v e") -> str:
    codes = S.quoted(V.WEEKDAY_CODES)
    return f"""SELECT e.*, UNNEST(CASE WHEN recurrence = 'weekly' AND coalesce(recur_days, '') <> '' THEN
      list_filter(list_transform(range(0, greatest(0, least({hi}, coalesce(recur_until, {hi})) - greatest({lo}, coalesce(event_date, {lo})) + 1)), lambda i: CAST(greatest({lo}, coalesce(event_date, {lo})) + CAST(i AS INTEGER) AS DATE)),
        lambda d: list_contains(string_split(recur_days, ','), ([{codes}])[CAST(isodow(d) AS INTEGER)]))
      ELSE list_filter([event_date], lambda d: d BETWEEN {lo} AND {hi}) END) AS day FROM {source}"""


@query("expand_recurrence", f"SELECT id, user_id, CAST(day AS VARCHAR) AS day, recurrence FROM ({expand_sql(f'({D} - 20)', f'({D} + 40)')})")
def expand_recurrence(t):
    today = F.lit(TODAY)
    out = H.expand_recurrence(t("calendar_events_v"), F.date_sub(today, 20), F.date_add(today, 40))
    return text_date(out.select("id", "user_id", "day", "recurrence"), "day")


def holiday_sql(years: str) -> str:
    parts = []
    for name, month, rule in V.HOLIDAYS:
        first = f"make_date(year, {month}, 1)"
        if isinstance(rule, int):
            day = f"make_date(year, {month}, {rule})"
        elif rule[1] > 0:
            day = f"{first} + CAST(({rule[0]} - (isodow({first}) - 1) + 7) % 7 + {7 * (rule[1] - 1)} AS INTEGER)"
        else:
            day = f"last_day({first}) - CAST(((isodow(last_day({first})) - 1) - {rule[0]} + 7) % 7 AS INTEGER)"
        parts.append(f"SELECT {day} AS day, {S.literal(name)} AS name FROM {years}")
        if name == "Thanksgiving":
            parts.append(f"SELECT {day} + 1, {S.literal(V.THANKSGIVING_BREAK)} FROM {years}")
    return " UNION ALL ".join(parts)


@query("holidays", f"WITH years AS (SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS INTEGER) AS year FROM orders) SELECT CAST(day AS VARCHAR) AS day, name FROM ({holiday_sql('years')})")
def holidays(t):
    return text_date(H.holidays(t("orders").select(F.year("o_orderdate").alias("year")).distinct()), "day")


def calendar_sql(ranges: str) -> str:
    """CTE `items` over a relation `ranges` (user_id, lo, hi)."""
    return f"""
occ AS ({expand_sql('lo', 'hi', f'(SELECT c.*, r.lo, r.hi FROM calendar_events_v c JOIN {ranges} r USING (user_id)) e')}),
yrs AS (SELECT DISTINCT UNNEST(range(year(lo), year(hi) + 1))::INTEGER AS year FROM {ranges}),
hol AS ({holiday_sql('yrs')}),
ticks AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, arg_max(done, (ts, event_id)) AS done FROM task_status_v GROUP BY ALL) WHERE done),
raw_items AS (
  SELECT s.user_id, 'sched:' || id AS item_id, due AS day, CASE WHEN kind = 'lecture' THEN 'concept' ELSE kind END AS kind, topic AS title, course_id, '' AS start_time, 'syllabus' AS source, false AS own, true AS chk FROM schedule_v s JOIN {ranges} r USING (user_id) WHERE due BETWEEN lo AND hi
  UNION ALL SELECT a.user_id, 'assess:' || id, due, kind, title, course_id, '', 'assessment', status = 'done', false FROM assessments_v a JOIN {ranges} r USING (user_id) WHERE due BETWEEN lo AND hi
  UNION ALL SELECT user_id, 'event:' || id || CASE WHEN recurrence = 'weekly' THEN ':' || day ELSE '' END, day, kind, title, course_id, start_time, 'event', recurrence <> 'weekly' AND done, true FROM occ
  UNION ALL SELECT r.user_id, 'holiday:' || h.day, h.day, 'holiday', h.name, '', '', 'holiday', false, false FROM {ranges} r JOIN hol h ON h.day BETWEEN r.lo AND r.hi),
items AS (SELECT i.user_id, i.item_id, i.day, i.kind, i.title, i.course_id, i.start_time, i.source, own OR (chk AND t.item_id IS NOT NULL) AS done FROM raw_items i LEFT JOIN ticks t ON t.user_id = i.user_id AND t.item_id = i.item_id)"""


def calendar_of(t, users, lo, hi):
    done = H.task_status_latest(t("task_status_v"))
    return H.calendar_items(t("schedule_v"), t("assessments_v"), t("calendar_events_v"), done, users, lo, hi)


@query("calendar_union", f"WITH ranges AS (SELECT DISTINCT user_id, {D} - 14 AS lo, {D} + 35 AS hi FROM schedule_v), {calendar_sql('ranges')} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM items")
def calendar_union(t):
    today = F.lit(TODAY)
    items = calendar_of(t, users_of(t), F.date_sub(today, 14), F.date_add(today, 35))
    return text_date(H.in_calendar_order(items), "day")


BOUNDS = f"""found AS (SELECT user_id, MIN(d) AS a, MAX(d) AS b FROM (SELECT user_id, due AS d FROM schedule_v UNION ALL SELECT user_id, due FROM assessments_v UNION ALL SELECT user_id, event_date FROM calendar_events_v UNION ALL SELECT user_id, recur_until FROM calendar_events_v) GROUP BY user_id),
bounds AS (SELECT u.user_id, CASE WHEN a IS NULL THEN {D} - 120 ELSE least(a, {D}) END AS lo, CASE WHEN b IS NULL THEN {D} + 120 ELSE greatest(b, {D}) END AS hi FROM (SELECT DISTINCT user_id FROM schedule_v) u LEFT JOIN found f USING (user_id))"""


def bounds_of(t):
    return H.term_bounds(users_of(t), t("schedule_v"), t("assessments_v"), t("calendar_events_v"), TODAY)


@query("term_bounds", f"WITH {BOUNDS} SELECT user_id, CAST(lo AS VARCHAR) AS term_start, CAST(hi AS VARCHAR) AS term_end FROM bounds")
def term_bounds(t):
    return text_date(bounds_of(t), "term_start", "term_end")


@query("calendar_progress", f"""WITH {BOUNDS}, {calendar_sql('bounds')}, work AS (SELECT user_id, day, done FROM items WHERE kind IN ({S.quoted(V.TASK_KINDS)})),
    r AS (SELECT user_id, 'semester' AS range, done FROM work UNION ALL SELECT user_id, 'today', done FROM work WHERE day = {D}
          UNION ALL SELECT user_id, 'week', done FROM work WHERE day BETWEEN CAST(date_trunc('week', {D}) AS DATE) AND CAST(date_trunc('week', {D}) AS DATE) + 6)
    SELECT user_id, range, COUNT(*) AS total, COUNT(*) FILTER (done) AS n_done, CAST(round_even(100.0::DOUBLE * COUNT(*) FILTER (done) / COUNT(*), 0) AS BIGINT) AS pct FROM r GROUP BY ALL""")
def calendar_progress(t):
    items = calendar_of(t, bounds_of(t), F.col("term_start"), F.col("term_end"))
    return H.calendar_progress(items, TODAY)


# --- lists and feeds ----------------------------------------------------------------------------------


@query("assessment_overdue", f"SELECT id, user_id, title, CAST(due AS VARCHAR) AS due, status, coalesce(due < {D}, false) AND status <> 'done' AS overdue FROM assessments_v")
def assessment_overdue(t):
    return text_date(H.assessment_list(t("assessments_v"), TODAY).select("id", "user_id", "title", "due", "status", "overdue"), "due")


@query("feed_alarms", f"""WITH cov AS (SELECT id, string_agg(c::VARCHAR, ', ' ORDER BY c) AS covers FROM (SELECT DISTINCT id, split_part(chapter_ref, ':', 3)::INTEGER AS c FROM schedule_refs_v) GROUP BY id)
    SELECT a.id, a.user_id, '[' || upper(course_id) || '] ' || CASE kind WHEN 'exam' THEN 'Exam' ELSE 'Due' END || ': ' || title AS summary, CASE WHEN kind IN ({S.quoted(V.EXAM_KINDS)}) THEN coalesce(covers, '') ELSE '' END AS covers, n AS days_before, CAST(due - n AS VARCHAR) AS alarm_on
    FROM (SELECT *, UNNEST([7, 3, 1]) AS n FROM assessments_v WHERE due IS NOT NULL AND status <> 'done') a LEFT JOIN cov USING (id)""")
def feed_alarms(t):
    return text_date(H.feed_alarms(t("assessments_v"), t("schedule_refs_v")), "alarm_on")


@query("task_status_latest", "SELECT user_id, item_id, arg_max(done, (ts, event_id)) AS done, CASE WHEN starts_with(item_id, 'assess:') THEN 'assessment' ELSE 'task' END AS target FROM task_status_v GROUP BY user_id, item_id")
def task_status_latest(t):
    return H.task_status_latest(t("task_status_v"))


@query("course_overview", """WITH c AS (SELECT DISTINCT user_id, course_id FROM schedule_v), n AS (SELECT user_id, course_id, COUNT(*) AS n_chunks FROM library_v GROUP BY ALL),
    s AS (SELECT user_id, course_id, COUNT(*) AS n_sources, string_agg(source_id, ',' ORDER BY source_id) AS sources FROM (SELECT DISTINCT user_id, course_id, source_id FROM library_v) GROUP BY ALL)
    SELECT user_id, course_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_sources, 0) AS n_sources, coalesce(sources, '') AS sources, n_chunks IS NOT NULL AS loaded FROM c LEFT JOIN n USING (user_id, course_id) LEFT JOIN s USING (user_id, course_id)""")
def course_overview(t):
    courses = t("schedule_v").select("user_id", "course_id").distinct()
    return H.course_overview(t("library_v"), t("library_v"), courses)
