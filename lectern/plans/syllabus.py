"""Syllabus queries: dates, schedule lines, payloads, diffs, chapter links, commits, reviews, meetings."""

from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import fixed_values as V
from lectern.operators import retrieval as R
from lectern.operators import syllabus as Y
from lectern.plans import sqltext as S
from lectern.plans.ingest import strip_sql
from lectern.plans.registry import query

DEFAULT_YEAR = 1998


def _ext(x: str, p: str, i: int) -> str:
    return f"regexp_extract({x}, {S.literal('(?i)' + p)}, {i})"


def _int(x: str, p: str, i: int) -> str:
    return f"try_cast(nullif({_ext(x, p, i)}, '') AS INTEGER)"


def _ymd(y: str, m: str, d: str) -> str:
    return f"try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0') AS DATE)"


def date_sql(x: str, year: str = str(DEFAULT_YEAR)) -> str:
    us_year = f"coalesce({_int(x, V.US_DATE, 3)}, {year})"
    us_year = f"CASE WHEN {us_year} < 100 THEN {us_year} + 2000 ELSE {us_year} END"
    month = f"list_position([{S.quoted(V.MONTHS)}], substr(lower({_ext(x, V.MONTH_DAY, 1)}), 1, 3))"
    return (
        f"CASE WHEN {S.has(x, V.ISO_DATE)} THEN {_ymd(*[_int(x, V.ISO_DATE, i) for i in (1, 2, 3)])} "
        f"WHEN {S.has(x, V.US_DATE)} THEN {_ymd(us_year, _int(x, V.US_DATE, 1), _int(x, V.US_DATE, 2))} "
        f"WHEN {S.has(x, V.MONTH_DAY)} THEN {_ymd(year, month, _int(x, V.MONTH_DAY, 2))} END"
    )


def week_sql(week: str, start: str, days: str) -> str:
    index = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.WEEKDAY_INDEX.items())
    moved = f"list_transform({days}, lambda wd: CAST(date_trunc('week', {start}) AS DATE) + CAST(({week} - 1) * 7 + CASE substr(lower(trim(wd)), 1, 9) {index} END AS INTEGER))"
    return f"list_sort(list_filter({moved}, lambda wd: wd IS NOT NULL AND wd >= {start}))"


def kind_sql(x: str) -> str:
    return f"CASE WHEN {S.has(x, V.EXAM)} THEN 'exam' WHEN {S.has(x, V.DUE)} THEN 'due' ELSE 'lecture' END"


@query("parse_dates", f"SELECT id, said, CAST({date_sql('said')} AS VARCHAR) AS parsed FROM dates_v")
def parse_dates(t):
    return t("dates_v").select("id", "said", D.parse_date(F.col("said"), F.lit(DEFAULT_YEAR)).cast("string").alias("parsed"))


_DAYS = "CASE WHEN id % 3 = 0 THEN 'Tue,Thurs' WHEN id % 3 = 1 THEN 'Friday,mon,nonday' ELSE 'Wednesday' END"


@query("expand_week", f"SELECT id, array_to_string({week_sql('(id % 16 + 1)', 'd', f'string_split({_DAYS}, chr(44))')}, ',') AS dates FROM dates_v")
def expand_week(t):
    days = F.split(F.expr(_DAYS), ",")
    dates = D.expand_week((F.col("id") % 16 + 1).cast("int"), F.col("d"), days)
    return t("dates_v").select("id", F.array_join(F.transform(dates, lambda d: d.cast("string")), ",").alias("dates"))


LINES = f"""sl AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM syllabi_v)"""


@query("classify_rows", f"WITH {LINES} SELECT doc_id, line_no, {kind_sql('raw')} AS kind, {S.has('raw', V.HOLIDAY)} AS holiday, {S.has('raw', V.HEADER_LINE)} AS header FROM sl")
def classify_rows(t):
    from lectern.functions.common import matches

    lines = t("syllabi_v").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    raw = F.col("raw")
    return lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), D.row_kind(raw).alias("kind"), D.is_holiday(raw).alias("holiday"), matches(raw, V.HEADER_LINE).alias("header")
    )


_READING = "'Mankiw Ch. ' || (id % 45) || ', ' || (id % 20) || '.1-' || (id % 20) || '.3; ' || topic"


@query("reading_refs", f"""WITH prim AS (SELECT user_id, course_id, MIN(source_id) AS source_id FROM library_v WHERE user_id <> 'u7' GROUP BY ALL)
    SELECT s.id, coalesce(array_to_string(CASE WHEN p.source_id IS NULL THEN [] ELSE list_transform({S.mentions(_READING)}, lambda n: s.course_id || ':' || p.source_id || ':' || n) END, ','), '') AS refs
    FROM schedule_v s LEFT JOIN prim p USING (user_id, course_id)""")
def reading_refs(t):
    primaries = t("library_v").where("user_id <> 'u7'").groupBy("user_id", "course_id").agg(F.min("source_id").alias("source_id"))
    rows = t("schedule_v").select("id", "user_id", "course_id", F.expr(_READING).alias("reading"))
    return Y.reading_refs(rows, primaries).select("id", F.array_join("refs", ",").alias("refs"))


_PREFIX = S.quoted(sorted({n[:3] for n in V.WEEKDAY_INDEX}))


@query("syllabus_rows", f"""WITH h AS (SELECT doc_id, text, {date_sql(_ext('text', V.TERM_START_LINE, 1))} AS term_start,
        list_filter(string_split_regex({_ext('text', V.MEETS_LINE, 1)}, '[,/ ]+'), lambda d: substr(lower(d), 1, 3) IN ({_PREFIX}))[1:4] AS days FROM syllabi_v),
    l0 AS (SELECT doc_id, term_start, days, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM h),
    l AS (SELECT *, {strip_sql('raw')} AS line, {_int('raw', V.WEEK_REF, 1)} AS wk FROM l0),
    w AS (SELECT *, coalesce({date_sql('line', f'coalesce(year(term_start), {DEFAULT_YEAR})')}, CASE WHEN term_start IS NOT NULL AND wk IS NOT NULL THEN {week_sql('wk', 'term_start', 'days')}[1] END) AS date FROM l WHERE length(line) >= 6),
    r AS (SELECT *, {kind_sql('line')} AS kind, CASE WHEN {strip_sql("regexp_replace(line, '^[^|]*\\|', '')")} = '' THEN line ELSE {strip_sql("regexp_replace(line, '^[^|]*\\|', '')")} END AS body
          FROM w WHERE date IS NOT NULL AND NOT {S.has('line', V.HOLIDAY)} AND NOT {S.has('line', V.HEADER_LINE)})
    SELECT doc_id, line_no, CAST(date AS VARCHAR) AS date, kind, CASE kind WHEN 'exam' THEN CASE WHEN {S.has('line', chr(92) + 'bfinal' + chr(92) + 'b')} THEN 'final' ELSE 'midterm' END
        WHEN 'due' THEN CASE WHEN {S.has('line', chr(92) + 'b(paper|essay)' + chr(92) + 'b')} THEN 'paper' ELSE 'problem_set' END ELSE 'meeting' END AS item,
      substr(body, 1, CASE WHEN kind = 'lecture' THEN 120 ELSE 60 END) AS title, body AS covers,
      CASE WHEN kind = 'exam' OR (kind = 'lecture' AND {S.has('line', V.WEEK_REF)}) THEN 'low' ELSE 'high' END AS confidence FROM r""")
def syllabus_rows(t):
    out = Y.schedule_lines(t.spread("syllabi_v"), ["doc_id"], DEFAULT_YEAR)
    return out.withColumns({"line_no": F.col("line_no").cast("long"), "date": F.col("date").cast("string")})


_PSTART = "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '1997-0' || (doc_id % 9 + 1) || '-05' END"
_PYEAR = "CASE WHEN doc_id % 4 = 0 THEN 1998 ELSE 1997 END"


@query("payload_rows", f"""SELECT doc_id, 'meeting' AS section, CAST({date_sql('said', _PYEAR)} AS VARCHAR) AS date, 'lecture' AS kind, topic AS title, 0.0::DOUBLE AS weight, coalesce(confidence, 'high') AS confidence
      FROM payload_meetings_v WHERE trim(topic) <> '' AND NOT {S.has('topic', V.HOLIDAY)}
    UNION ALL SELECT doc_id, 'assessment', CAST({date_sql('said', _PYEAR)} AS VARCHAR), CASE WHEN replace(lower(coalesce(kind, 'quiz')), ' ', '_') IN ({S.quoted(V.ASSESSMENT_KINDS)}) THEN replace(lower(coalesce(kind, 'quiz')), ' ', '_') ELSE 'quiz' END,
      title, coalesce(try_cast(weight AS DOUBLE), 0.0), 'high' FROM payload_assessments_v WHERE trim(title) <> '' OR {date_sql('said', _PYEAR)} IS NOT NULL""")
def payload_rows(t):
    m = t("payload_meetings_v").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("said").alias("date"), "topic", "confidence")).alias("meetings"))
    a = t("payload_assessments_v").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("said").alias("date"), "kind", "title", "weight")).alias("assessments"))
    course = F.struct(F.expr(_PSTART).alias("term_start"))
    docs = m.join(a, "doc_id").select("doc_id", F.to_json(F.struct(course.alias("course"), "meetings", "assessments")).alias("payload"))
    out = Y.payload_rows(docs, ["doc_id"], DEFAULT_YEAR)
    return out.select("doc_id", "section", F.col("date").cast("string").alias("date"), "kind", "title", "weight", "confidence")


# --- diff ------------------------------------------------------------------------------------

def _side_sql(name: str, refs: str) -> str:
    key = "CASE WHEN section = 'meeting' THEN lower(trim(title)) ELSE kind || '|' || substr(lower(trim(title)), 1, 24) END"
    return f"""{name} AS (SELECT * FROM (SELECT e.user_id, e.course_id, e.section, coalesce(CAST(e.due AS VARCHAR), 'no-date') AS day, {key} AS match_key, e.weight, {refs} AS refs,
      row_number() OVER (PARTITION BY e.user_id, e.course_id, e.section, coalesce(CAST(e.due AS VARCHAR), 'no-date'), {key} ORDER BY e.id DESC) AS rn
      FROM extraction_{name}_v e LEFT JOIN refs r USING (id)) WHERE rn = 1)"""


DIFF = f"""refs AS (SELECT id, list_sort(list(chapter_ref)) AS rs FROM schedule_refs_v GROUP BY id),
{_side_sql('a', "coalesce(r.rs, [])")}, {_side_sql('b', "CASE WHEN id % 5 = 0 THEN [] ELSE coalesce(r.rs, []) END")},
judged AS (SELECT user_id, course_id, section, day, match_key, CASE WHEN a.rn IS NULL OR b.rn IS NULL THEN ['presence'] ELSE list_filter([
      CASE WHEN a.refs IS DISTINCT FROM b.refs THEN CASE WHEN section = 'meeting' THEN 'chapter_refs' ELSE 'covers' END END,
      CASE WHEN section = 'assessment' AND a.weight IS DISTINCT FROM b.weight THEN 'weight' END], lambda x: x IS NOT NULL) END AS fields
   FROM a FULL JOIN b USING (user_id, course_id, section, day, match_key))"""


def _diff(t):
    refs = t("schedule_refs_v").groupBy("id").agg(F.sort_array(F.collect_list("chapter_ref")).alias("rs"))
    none = F.array().cast("array<string>")

    def side(name, dropped):
        rows = t(f"extraction_{name}_v").join(refs, "id", "left")
        found = F.coalesce("rs", none)
        found = F.when(F.col("id") % 5 == 0, none).otherwise(found) if dropped else found
        return rows.select("user_id", "course_id", "section", F.col("id").alias("pos"), F.col("due").alias("date"), "kind", "title", "weight", found.alias("refs"))

    return Y.extraction_diff(side("a", False), side("b", True), ["user_id", "course_id"])


@query("extraction_diff", f"WITH {DIFF} SELECT user_id, course_id, section, day, match_key, UNNEST(fields) AS field FROM judged")
def extraction_diff(t):
    return _diff(t)[0]


@query("agreement_rate", f"""WITH {DIFF}, g AS (SELECT user_id, course_id, COUNT(*) AS total_rows, COUNT(*) FILTER (len(fields) = 0) AS agreed_rows, CAST(SUM(len(fields)) AS BIGINT) AS conflicts FROM judged GROUP BY ALL)
    SELECT *, round(CASE WHEN total_rows = 0 THEN 1.0 ELSE agreed_rows::DOUBLE / total_rows END, 4) AS rate, conflicts > 0 AS needs_review FROM g""")
def agreement_rate(t):
    return Y.agreement_rate(_diff(t)[1])


# --- links ---------------------------------------------------------------------------------------

CHAPTERS = """ch AS (SELECT c.*, e.embedding::DOUBLE[] AS emb, row_number() OVER (PARTITION BY user_id, course_id ORDER BY source_id, chapter_num) AS place FROM
    (SELECT user_id, course_id, source_id, chapter_num, arg_min(chapter_title, ordinal) AS title, MIN(ordinal) AS first_chunk FROM chunks_v WHERE chapter_num <> 0 GROUP BY ALL) c LEFT JOIN embeddings e ON e.vec_id = c.first_chunk)"""


def link_sql(rows: str, keys: str) -> str:
    """CTE `linked` for `rows` (keys, course_id, query, emb)."""
    return f"""
lr AS (SELECT {keys}, course_id, {strip_sql('query')} AS query, emb, {S.title_tokens('query')} AS qw, {S.mentions('query')} AS stated FROM {rows}),
lc AS (SELECT *, {S.title_tokens('title')} AS cw FROM ch),
lp AS (SELECT r.*, c.source_id, c.chapter_num, c.title, c.place, list_contains(r.stated, c.chapter_num) AS agrees,
    round(greatest({S.set_similarity('r.qw', 'c.cw')}, {V.LINK_EMBEDDING_WEIGHT} * coalesce(list_cosine_similarity(r.emb, c.emb), 0.0))
      + CASE WHEN list_contains(r.stated, c.chapter_num) THEN {V.LINK_NUMBER_BONUS} ELSE 0 END, 6) AS score
  FROM lr r JOIN lc c ON c.user_id = r.user_id AND c.course_id = r.course_id),
lo AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, place) AS n, lead(score) OVER (PARTITION BY {keys} ORDER BY score DESC, place) AS runner,
    bool_or(agrees) OVER (PARTITION BY {keys}) AS any_number FROM lp),
linked AS (SELECT {keys}, query, CASE WHEN query = '' OR score < {V.LINK_FLOOR} OR coalesce(score - runner < {V.LINK_AMBIGUITY}, false) THEN NULL ELSE course_id || ':' || source_id || ':' || chapter_num END AS chapter_ref,
    CASE WHEN query = '' THEN '' ELSE title END AS chapter_title, CASE WHEN query = '' THEN 0.0 ELSE score END AS score,
    CASE WHEN query = '' THEN 'empty-row' ELSE 'semantic' || CASE WHEN any_number THEN '+number' ELSE '' END || CASE WHEN coalesce(score - runner < {V.LINK_AMBIGUITY}, false) AND score >= {V.LINK_FLOOR} THEN '/ambiguous' ELSE '' END END AS method,
    query = '' OR score < {V.LINK_FLOOR} OR coalesce(score - runner < {V.LINK_AMBIGUITY}, false) AS needs_review, CASE WHEN query <> '' THEN runner END AS runner_up FROM lo WHERE n = 1)"""


def unit_vectors(t):
    return R.l2_normalise(t("embeddings").select("vec_id", "embedding"))


def chapters_of(t):
    numbered = t("chunks_v").where("chapter_num <> 0")
    ch = numbered.groupBy("user_id", "course_id", "source_id", "chapter_num").agg(
        F.min_by("chapter_title", "ordinal").alias("title"), F.min("ordinal").alias("vec_id")
    )
    return ch.join(unit_vectors(t), "vec_id", "left").drop("vec_id")


@query("chapter_link", f"""WITH {CHAPTERS}, lrows AS (SELECT l.*, e.embedding::DOUBLE[] AS emb FROM link_rows_v l LEFT JOIN embeddings e ON e.vec_id = l.row_id), {link_sql('lrows', 'user_id, row_id')}
    SELECT user_id, row_id, chapter_ref, md5(chapter_title) AS title_hash, score, method, needs_review, runner_up FROM linked""")
def chapter_link(t):
    rows = t("link_rows_v").join(unit_vectors(t).withColumnRenamed("vec_id", "row_id"), "row_id", "left")
    out = Y.chapter_link(rows, chapters_of(t), ["user_id", "row_id"])
    return out.withColumn("title_hash", F.md5(F.col("chapter_title").cast("binary"))).drop("chapter_title")


@query("number_link", f"""WITH {CHAPTERS}, last AS (SELECT user_id, course_id, chapter_num, MAX(source_id) AS source_id FROM ch GROUP BY ALL),
    st AS (SELECT user_id, row_id, course_id, UNNEST(ms) AS n, generate_subscripts(ms, 1) AS pos FROM (SELECT *, {S.mentions('query')} AS ms FROM link_rows_v)),
    hit AS (SELECT st.user_id, st.row_id, arg_min(st.course_id || ':' || l.source_id || ':' || n, pos) AS chapter_ref FROM st JOIN last l ON l.user_id = st.user_id AND l.course_id = st.course_id AND l.chapter_num = st.n GROUP BY ALL)
    SELECT r.user_id, r.row_id, h.chapter_ref FROM link_rows_v r LEFT JOIN hit h USING (user_id, row_id)""")
def number_link(t):
    return Y.number_link(t("link_rows_v"), chapters_of(t), ["user_id", "row_id"])


_EXTRACTED = """SELECT user_id, chunk_id AS row_id, course_id, CASE WHEN chunk_id % 2 = 0 THEN 'meeting' ELSE 'assessment' END AS section,
    CASE chunk_id % 4 WHEN 1 THEN 'midterm' WHEN 3 THEN 'problem_set' ELSE 'quiz' END AS kind,
    CASE WHEN chunk_id % 9 = 1 AND chunk_id % 2 = 1 THEN '' ELSE 'Item ' || chunk_id END AS title, chapter_title AS cover1, 'ch. ' || (chunk_id % 22) || ' ' || source_id AS cover2,
    CASE WHEN chunk_id % 10 = 0 THEN 'low' ELSE 'high' END AS confidence FROM {chunks_v}"""


@query("schedule_rows", f"""WITH {CHAPTERS}, ex AS ({_EXTRACTED.replace('{', '').replace('}', '')}),
    items AS (SELECT user_id, row_id, course_id, 0 AS item_no, title || ' ' || cover1 || ' ' || cover2 AS query FROM ex WHERE section = 'meeting'
      UNION ALL SELECT user_id, row_id, course_id, 0, cover1 FROM ex WHERE section <> 'meeting' UNION ALL SELECT user_id, row_id, course_id, 1, cover2 FROM ex WHERE section <> 'meeting'),
    lrows AS (SELECT i.*, e.embedding::DOUBLE[] AS emb FROM items i LEFT JOIN embeddings e ON e.vec_id = i.row_id), {link_sql('lrows', 'user_id, row_id, item_no')},
    g AS (SELECT user_id, row_id, round({S.exact_sum('score')} / COUNT(*), 8) AS link_score, bool_or(needs_review) AS flagged, coalesce(string_agg(chapter_ref, ',' ORDER BY item_no), '') AS chapter_refs,
          substr(coalesce(string_agg(CASE WHEN chapter_ref IS NOT NULL THEN chapter_title END, '; ' ORDER BY item_no), ''), 1, 120) AS link_title FROM linked GROUP BY ALL)
    SELECT e.user_id, e.row_id, CASE WHEN section = 'meeting' THEN 'lecture' WHEN kind = 'midterm' THEN 'exam' ELSE 'due' END AS kind,
      CASE WHEN title = '' AND section <> 'meeting' THEN CASE kind WHEN 'midterm' THEN 'Midterm' WHEN 'problem_set' THEN 'Problem Set' ELSE 'Quiz' END ELSE title END AS topic,
      link_score, chapter_refs, link_title, flagged OR confidence = 'low' AS needs_review FROM ex e JOIN g USING (user_id, row_id)""")
def schedule_rows(t):
    ex = t.spark.sql(_EXTRACTED, chunks_v=t("chunks_v"))
    ex = ex.join(unit_vectors(t).withColumnRenamed("vec_id", "row_id"), "row_id", "left")
    ex = ex.withColumns({"covers": F.array("cover1", "cover2"), "date": F.lit(None).cast("date"), "weight": F.lit(0.0)})
    out = Y.schedule_rows(ex, chapters_of(t), ["user_id", "row_id"])
    return out.select("user_id", "row_id", "kind", "topic", "link_score", "chapter_refs", "link_title", "needs_review")


# --- commit and review ------------------------------------------------------------------------------

_ORIGIN = "CASE id % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'manual' ELSE 'edited' END"


@query("schedule_replace", f"""WITH existing AS (SELECT id, user_id, course_id, kind, needs_review, {_ORIGIN} AS origin FROM schedule_v),
    fresh AS (SELECT row_id AS id, 'u' || (row_id % 7) AS user_id, 'c' || (row_id % 4 + 1) AS course_id, 'due' AS kind, row_id % 2 = 0 AS needs_review, 'extracted' AS origin FROM link_rows_v),
    kept AS (SELECT * FROM existing x WHERE NOT (origin = 'extracted' AND EXISTS (SELECT 1 FROM fresh f WHERE f.user_id = x.user_id AND f.course_id = x.course_id)) UNION ALL SELECT * FROM fresh),
    refs AS (SELECT id, COUNT(*) AS n_refs FROM schedule_refs_v GROUP BY id)
    SELECT user_id, course_id, COUNT(*) AS n_rows, COUNT(*) FILTER (kind = 'lecture') AS lectures, COUNT(*) FILTER (kind = 'exam') AS exams, COUNT(*) FILTER (kind = 'due') AS due_rows,
      COUNT(*) FILTER (coalesce(n_refs, 0) > 0) AS linked, COUNT(*) FILTER (coalesce(n_refs, 0) = 0) AS unlinked, COUNT(*) FILTER (needs_review) AS to_review FROM kept LEFT JOIN refs USING (id) GROUP BY ALL""")
def schedule_replace(t):
    existing = t("schedule_v").select("id", "user_id", "course_id", "kind", "needs_review", F.expr(_ORIGIN).alias("origin"))
    fresh = t("link_rows_v").selectExpr(
        "row_id AS id", "concat('u', row_id % 7) AS user_id", "concat('c', row_id % 4 + 1) AS course_id", "'due' AS kind", "row_id % 2 = 0 AS needs_review", "'extracted' AS origin"
    )
    rows = Y.replace_extracted(existing, fresh)
    refs = t("schedule_refs_v").groupBy("id").agg(F.count("*").alias("n_refs"))
    return Y.commit_summary(rows.join(refs, "id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0))))


@query("review_queue", """SELECT s.id, s.user_id, s.course_id, s.topic, c.flagged, c.total, coalesce(ch.n, 0) AS choices FROM schedule_v s
    JOIN (SELECT user_id, course_id, COUNT(*) FILTER (needs_review) AS flagged, COUNT(*) AS total FROM schedule_v GROUP BY ALL) c USING (user_id, course_id)
    LEFT JOIN (SELECT user_id, course_id, COUNT(*) AS n FROM (SELECT DISTINCT user_id, course_id, source_id, chapter_num FROM library_v) GROUP BY ALL) ch USING (user_id, course_id) WHERE s.needs_review""")
def review_queue(t):
    out = Y.review_queue(t("schedule_v"), t("library_v"))
    return out.select("id", "user_id", "course_id", "topic", "flagged", "total", "choices")


_FIXES = """SELECT CASE WHEN id % 3 = 1 THEN concat('x', user_id) ELSE user_id END AS user_id, id, event_id AS fix_no, CASE WHEN event_id % 4 = 0 THEN concat('Fixed ', event_id) END AS fix_topic,
    CASE WHEN event_id % 6 < 3 THEN concat('c2:s2:', event_id % 50) END AS fix_ref, event_id % 9 <> 0 AS resolved
    FROM (SELECT s.user_id, s.id, e.event_id FROM {schedule_v} s JOIN {events} e ON e.event_id % 5000 = s.id) f"""


@query("review_apply", f"""WITH fixes AS ({_FIXES.replace('{', '').replace('}', '')}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY fix_no DESC) AS rn FROM fixes) WHERE rn = 1)
    SELECT s.user_id, s.id, coalesce(fix_topic, topic) AS topic, coalesce(fix_ref, 'c1:s1:' || (s.id % 9)) AS chapter_ref, CASE WHEN fix_ref IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS link_score,
      CASE WHEN fix_ref IS NOT NULL THEN 'user' ELSE 'semantic' END AS link_method, CASE WHEN l.id IS NOT NULL THEN NOT resolved ELSE needs_review END AS needs_review
    FROM schedule_v s LEFT JOIN last l USING (user_id, id)""")
def review_apply(t):
    rows = t("schedule_v").selectExpr("user_id", "id", "topic", "concat('c1:s1:', id % 9) AS chapter_ref", "0.5D AS link_score", "'semantic' AS link_method", "needs_review")
    return Y.review_apply(rows, t.spark.sql(_FIXES, schedule_v=t("schedule_v"), events=t("events")))


# --- meetings -----------------------------------------------------------------------------------------

def days_sql(x: str) -> str:
    word = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DAY_WORDS.items())
    letter = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DAY_LETTERS.items())
    parts = f"string_split_regex(lower(trim({x})), '[\\s/,&]+')"
    compact = f"string_split(replace(replace(replace(replace(upper(trim({x})), 'TH', 'R'), 'TU', 'T'), 'SU', 'U'), 'SA', 'A'), '')"

    def known(src, table, v):
        codes = f"list_filter(list_transform({src}, lambda {v}: CASE {v} {table} END), lambda z: z IS NOT NULL)"
        return f"list_filter({codes}, lambda z, i: list_position({codes}, z) = i)"

    by_word, by_letter = known(parts, word, "p"), known(compact, letter, "q")
    worded = f"(len({parts}) > 1 OR {parts}[1] IN ({S.quoted(V.DAY_WORDS)}))"
    return f"CASE WHEN trim({x}) = '' THEN '' ELSE array_to_string(CASE WHEN {worded} AND len({by_word}) > 0 THEN {by_word} ELSE {by_letter} END, ',') END"


def time_sql(x: str) -> str:
    spoken, plain = r"'(?i)^(\d{1,2}):?(\d{2})?\s*([ap])\.?m?\.?$'", r"'^(\d{1,2}):(\d{2})$'"
    return (
        f"CASE WHEN regexp_matches(trim({x}), {spoken}) THEN printf('%02d:', regexp_extract(trim({x}), {spoken}, 1)::INTEGER % 12 + CASE WHEN lower(regexp_extract(trim({x}), {spoken}, 3)) = 'p' THEN 12 ELSE 0 END) "
        f"|| CASE WHEN regexp_extract(trim({x}), {spoken}, 2) = '' THEN '00' ELSE regexp_extract(trim({x}), {spoken}, 2) END "
        f"WHEN regexp_matches(trim({x}), {plain}) THEN printf('%02d:', regexp_extract(trim({x}), {plain}, 1)::INTEGER) || regexp_extract(trim({x}), {plain}, 2) ELSE '' END"
    )


@query("meeting_normalise", f"SELECT id, {days_sql('days')} AS days, {time_sql('start_time')} AS start_time FROM meeting_texts_v")
def meeting_normalise(t):
    return t("meeting_texts_v").select("id", D.meeting_days(F.col("days")).alias("days"), D.clock_time(F.col("start_time")).alias("start_time"))


@query("meeting_events", f"""WITH stated AS (SELECT *, try_cast(trim(said) AS DATE) AS day FROM key_dates_v WHERE regexp_matches(trim(said), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast(trim(said) AS DATE) IS NOT NULL),
    found AS (SELECT user_id, course_id, MIN(day) AS lo, MAX(day) AS hi FROM stated GROUP BY ALL),
    bounds AS (SELECT user_id, course_id, CASE WHEN lo IS NULL THEN term_start ELSE coalesce(term_start, least(lo, coalesce(term_end, hi) - 120)) END AS d0, coalesce(term_end, hi) AS d1 FROM terms_v FULL JOIN found USING (user_id, course_id)),
    weekly AS (SELECT m.user_id, m.course_id, 'Class' || CASE WHEN trim(label) <> '' THEN ' · ' || substr(trim(label), 1, 40) ELSE '' END AS title, 'class' AS kind, d0 AS date, 'weekly' AS recurrence, {days_sql('days')} AS recur_days, d1 AS recur_until,
        {time_sql('start_time')} AS start_time, {time_sql("''")} AS end_time, substr(trim(location), 1, 80) AS location FROM meeting_texts_v m JOIN bounds b USING (user_id, course_id) WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND {days_sql('days')} <> '')
    SELECT user_id, course_id, title, kind, CAST(date AS VARCHAR) AS date, recurrence, recur_days, CAST(recur_until AS VARCHAR) AS recur_until, start_time, end_time, location FROM weekly
    UNION ALL SELECT user_id, course_id, substr(trim(title), 1, 80), CASE WHEN lower(trim(coalesce(kind, 'deadline'))) IN ('exam', 'deadline', 'project') THEN lower(trim(coalesce(kind, 'deadline'))) ELSE 'deadline' END, CAST(day AS VARCHAR), 'none', NULL, NULL, NULL, NULL, NULL FROM stated""")
def meeting_events(t):
    meetings = t("meeting_texts_v").withColumn("end_time", F.lit(""))
    out = Y.meeting_events(meetings, t("key_dates_v").withColumnRenamed("said", "date"), t("terms_v"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("date", "recur_until")})


_CODE = r"([A-Z]{2,8})\s*[- ]?(\d{1,4})"
_UP = f"upper(substr({strip_sql('text')}, 1, 6000))"


@query("syllabus_candidates", f"""WITH u AS (SELECT *, {strip_sql('text')} AS clean, regexp_extract(upper(code), '{_CODE}', 1) AS subject, regexp_extract(upper(code), '{_CODE}', 2) AS number,
        contains(lower(course_title), 'calculus') OR starts_with(regexp_extract(upper(code), '{_CODE}', 1), 'CALC') AS calc, contains(lower(course_title), 'computer science') AS comp,
        list_transform(list_zip(regexp_extract_all({_UP}, '{V.SYLLABUS_CODE}', 1), regexp_extract_all({_UP}, '{V.SYLLABUS_CODE}', 2)), lambda z: {{'s': z[1], 'n': z[2]}}) AS codes FROM syllabus_files_v
        WHERE {strip_sql('text')} <> '' AND (explicit OR {S.has('file_name', V.SYLLABUS_NAME)} OR ({S.has('substr(' + strip_sql('text') + ', 1, 12000)', chr(92) + 'bsyllabus' + chr(92) + 'b')} AND {S.has('substr(' + strip_sql('text') + ', 1, 12000)', V.SYLLABUS_STRUCTURE)}))),
    o AS (SELECT *, list_filter(codes, lambda c: c.s = subject OR (comp AND c.s IN ('CS', 'CSC', 'CSCI')) OR (calc AND c.s IN ('MATH', 'MAT', 'CALC'))) AS own, list_filter(codes, lambda c: c.s IN ({S.quoted(V.ACADEMIC_PREFIXES)})) AS acad FROM u),
    j AS (SELECT *, (len(own) > 0 AND NOT (calc AND len(list_filter(own, lambda c: c.s IN ('MATH', 'MAT', 'CALC'))) > 0) AND len(list_filter(own, lambda c: c.s = subject AND c.n = number)) = 0)
             OR (len(own) = 0 AND length(number) >= 2 AND len(acad) > 0 AND len(list_filter(acad, lambda c: c.n = number)) = 0) AS other FROM o),
    k AS (SELECT *, sha256(clean) AS text_hash FROM j WHERE subject = '' OR number = '' OR NOT other),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, course_id, text_hash ORDER BY explicit DESC, file_name, source_id) AS rn FROM k) WHERE rn = 1)
    SELECT user_id, course_id, source_id, file_name, explicit, text_hash, row_number() OVER (PARTITION BY user_id, course_id ORDER BY explicit DESC, lower(file_name), source_id) AS choice FROM b""")
def syllabus_candidates(t):
    return Y.syllabus_candidates(t("syllabus_files_v")).withColumn("choice", F.col("choice").cast("long"))
