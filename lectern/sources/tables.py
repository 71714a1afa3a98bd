"""Tables and bindings.

A binding is one portable SELECT that gives a base table the role the operators expect (chunks,
questions, schedule rows, events ...). The same text runs in Spark and as a CTE of the SQL check.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = "1998-06-03"

BINDINGS: dict[str, str] = {
    # --- corpus and questions -------------------------------------------------
    "chunks_v": """
        SELECT doc_id AS chunk_id, 'u' || (doc_id % 3) AS user_id, lang AS course_id, source AS source_id,
               doc_id AS ordinal, doc_id % 20 AS chapter_num,
               split_part(text, chr(10), 1) AS chapter_title, '' AS section,
               doc_id % 100 + 1 AS page_start, doc_id % 100 + 1 + doc_id % 3 AS page_end, text
        FROM {documents}""",
    "questions_v": """
        SELECT 'u' || tenant AS user_id, item_id AS q_id, text AS q,
               CASE WHEN item_id % 2 = 0 THEN 'natural' ELSE 'generated' END AS slice
        FROM (SELECT item_id, text, 0 AS tenant FROM {benchmark}
              UNION ALL SELECT item_id, text, 1 FROM {benchmark}
              UNION ALL SELECT item_id, text, 2 FROM {benchmark}) b""",
    "asked_v": """
        SELECT conv_id * 1000 + turn AS q_id, 'u' || (conv_id % 3) AS user_id, text AS q,
               CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN 'en'
                    WHEN conv_id % 4 = 2 THEN 'fr' ELSE 'de' END AS course_id
        FROM {conversations} WHERE role = 'user'""",
    # the asked texts, phrased as the questions students put to the system
    "phrased_v": """
        SELECT q_id, user_id, course_id,
               CASE WHEN q_id % 9 = 0 THEN 'What is the current value of ' || q || '?'
                    WHEN q_id % 9 = 1 THEN 'Translate this into French: ' || q
                    WHEN q_id % 9 = 2 THEN 'What grade did I get for ' || q
                    WHEN q_id % 9 = 3 THEN 'Show me the trend in ' || q
                    WHEN q_id % 9 = 4 THEN 'Who is the present chair of ' || q || '?'
                    WHEN q_id % 9 = 5 THEN 'Summarise chapter ' || (q_id % 31) || ': ' || q
                    WHEN q_id % 9 = 6 THEN 'What is the correlation between ' || q || ' and growth?'
                    WHEN q_id % 9 = 7 THEN 'What is ' || q || '? How does it play into the real world? Give me an example and explain it'
                    ELSE q END AS q
        FROM {asked_v}""",
    # the same, some of them asked within a chapter
    "searched_v": """
        SELECT q_id, user_id, course_id, q, CASE WHEN q_id % 13 = 6 THEN q_id % 20 END AS chapter_num FROM {phrased_v}""",
    "chunk_vectors_v": """
        SELECT 'u' || (vec_id % 3) AS user_id, vec_id AS chunk_id, label AS course_id,
               vec_id % 20 AS chapter_num, embedding FROM {embeddings}""",
    # every vector whose id is divisible by 20 asks all vectors of its tenant; some keep to a course or chapter
    "vector_queries_v": """
        SELECT 'u' || (vec_id % 3) AS user_id, vec_id AS q_id, embedding,
               CASE WHEN vec_id % 40 = 0 THEN label END AS want_course,
               CASE WHEN vec_id % 60 = 0 THEN vec_id % 7 END AS want_chapter
        FROM {embeddings} WHERE vec_id % 20 = 0""",
    "query_vectors_v": """
        SELECT q.user_id, q.q_id, e.label AS course_id, q.q_id % 20 AS chapter_num, e.embedding
        FROM {questions_v} q JOIN {embeddings} e ON e.vec_id = q.q_id""",
    "courses_v": """
        SELECT user_id, course_id, MAX(CASE WHEN course_id IN ('en', 'fr') THEN 1 ELSE 0 END) = 1 AS has_data_link
        FROM {chunks_v} GROUP BY user_id, course_id""",
    # --- page text and files --------------------------------------------------
    "marker_docs_v": """
        SELECT doc_id, '<!-- chapter: ' || (doc_id % 12) || ' | title: Part ' || (doc_id % 7) || ' -->' || chr(10)
               || '<!-- page: ' || (doc_id % 300 + 1) || ' -->' || chr(10)
               || replace(text, '.' || chr(10), '.' || chr(10) || '<!-- section: S' || (doc_id % 5) || ' -->' || chr(10))
               || chr(10) || '<!-- Chapter:  ' || (doc_id % 9) || '|title:  Coda  -->' || chr(10) || lang AS text
        FROM {documents}""",
    "heading_pages_v": """
        SELECT source AS source_id, doc_id AS page,
               CASE WHEN doc_id % 17 = 0 THEN '   ' ELSE
               CASE doc_id % 3 WHEN 0 THEN '12' WHEN 1 THEN 'MARKETS AND PRICES' ELSE 'Plain first line' END || chr(10) ||
               CASE doc_id % 7 WHEN 0 THEN 'Chapter ' || (doc_id % 30 + 1) || ': Title ' || (doc_id % 11)
                    WHEN 1 THEN 'CHAPTER XIV' WHEN 2 THEN (doc_id % 9 + 1) || '.' || (doc_id % 8) || ' Section name'
                    WHEN 3 THEN 'chapter 7 emphasizes the role of symbols' WHEN 4 THEN 'Chapter 12'
                    WHEN 5 THEN 'Chapter VI The Return' ELSE '' END || chr(10) || text END AS text
        FROM {documents}""",
    "math_pages_v": """
        SELECT doc_id, 'u' || (doc_id % 3) AS user_id, source AS source_id, doc_id % 90 + 1 AS page,
               CASE doc_id % 6 WHEN 0 THEN 'Definition 3.1 A market clears.' || chr(10) || chr(10)
                    WHEN 1 THEN '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10)
                    WHEN 2 THEN 'y = ax^2 + b' || chr(10) || chr(10) WHEN 3 THEN 'U(x1, x2) = x1^a' || chr(10) || '(4)' || chr(10) ELSE '' END ||
               replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '. ',
                   '.' || chr(10) || 'p1x1 + p2x2 = m' || (doc_id % 9) || chr(10) || '3x_' || (doc_id % 4) || chr(10) || '(2.' || (doc_id % 9) || ')' || chr(10)) AS text
        FROM {documents}""",
    "outline_v": """
        SELECT 'b' || (o_custkey % 40) AS source_id, o_orderkey % 700 AS page, o_orderkey AS entry_no,
               o_orderkey % 3 + 1 AS level,
               CASE o_custkey % 6 WHEN 0 THEN 'Chapter ' || (o_orderkey % 40) || ' The Market' WHEN 1 THEN 'Chapter XIV.'
                    WHEN 2 THEN 'p. ' || (o_orderkey % 999) WHEN 3 THEN ' Supply ' WHEN 4 THEN 'chapter 5' ELSE 'Demand' END AS title
        FROM {orders}""",
    "book_pages_v": """
        SELECT 'b' || (l_suppkey % 40) AS source_id, l_partkey % 900 + 1 AS page FROM {lineitem}""",
    "files_v": """
        SELECT page_id, 'u' || (page_id % 3) AS user_id, 'ECON ' || (page_id % 5) AS course_id, html AS content,
               CASE page_id % 6 WHEN 0 THEN 'Lecture_' WHEN 1 THEN 'Intro to Book ' WHEN 2 THEN 'handout-' WHEN 3 THEN 'bbplus slides '
                    WHEN 4 THEN '' ELSE 'Paper (v2) ' END || regexp_replace(url, 'https?://', '') ||
               CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.md' ELSE '' END AS filename
        FROM {pages}""",
    "file_reports_v": """
        SELECT event_id, 'u' || (user_id % 20) AS user_id, 'c' || (event_id % 5) AS course_id, 'file' || event_id AS filename,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unsupported' ELSE 'ok' END AS status,
               CASE WHEN event_type = 'error' THEN 'RuntimeError' ELSE 'ExtractionError' END AS error_kind,
               CASE event_id % 5 WHEN 0 THEN 'Cannot open empty file' WHEN 1 THEN 'document is Encrypted'
                    WHEN 2 THEN 'no such thing: ''/srv/uploads/u1/x y.pdf'' for /tmp/a' WHEN 3 THEN 'Unsupported file type .zip'
                    ELSE 'bad xref at ' || event_type END AS error,
               CAST(floor(value) AS BIGINT) AS chunks, event_id % 40 AS pages
        FROM {events}""",
    # --- syllabi ---------------------------------------------------------------
    "dates_v": """
        SELECT o_orderkey AS id, o_orderpriority, CAST(o_orderdate AS DATE) AS d,
               CASE o_orderkey % 7 WHEN 0 THEN 'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' class'
                    WHEN 1 THEN extract(month FROM o_orderdate) || '/' || extract(day FROM o_orderdate) || ' review'
                    WHEN 2 THEN extract(month FROM o_orderdate) || '/' || extract(day FROM o_orderdate) || '/' || (extract(year FROM o_orderdate) % 100)
                    WHEN 3 THEN split_part('Jan,February,Mar.,April,May,June,Jul,Aug,Sept.,Oct,Nov,Dec', ',', CAST(extract(month FROM o_orderdate) AS INT)) || ' ' || (o_orderkey % 33)
                    WHEN 4 THEN 'sep 31' WHEN 5 THEN '1998-13-01' ELSE 'TBA' END AS said
        FROM {orders}""",
    "syllabi_v": """
        SELECT o_orderkey AS doc_id, 'u' || (o_custkey % 20) AS user_id,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ECON ' || (o_orderkey % 900 + 100) || ': Markets' || chr(10) END ||
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Term starts: ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || chr(10) END ||
               'Semester ends ' || extract(month FROM o_orderdate) || '/' || extract(day FROM o_orderdate) || '/1999' || chr(10) ||
               CASE o_orderkey % 3 WHEN 0 THEN 'Meets: Tue, Thurs, Fri' WHEN 1 THEN 'Meeting days Mon/Wed' ELSE 'Meets in room' END || chr(10) ||
               extract(month FROM o_orderdate) || '/' || extract(day FROM o_orderdate) || ' | Supply (ch. ' || (o_orderkey % 40) || ')' || chr(10) ||
               'Week ' || (o_orderkey % 15 + 1) || ' | Consumer choice, Ch. ' || (o_custkey % 30) || chr(10) ||
               'Week 3' || chr(10) || 'Oct 12 | Midterm ' || (o_orderkey % 3) || chr(10) || 'Oct ' || (o_orderkey % 35) || ' | Problem set due' || chr(10) ||
               'Dec 9: Final exam, all chapters' || chr(10) || 'Nov 26 | Thanksgiving break' || chr(10) || 'Office hours 9/14' || chr(10) ||
               '11/3 | Essay ' || o_orderpriority || chr(10) || 'x' AS text
        FROM {orders}""",
    "payload_meetings_v": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS said,
               CASE l_linenumber % 5 WHEN 0 THEN 'Thanksgiving holiday' WHEN 1 THEN '  ' ELSE 'Topic ' || l_partkey END AS topic,
               CASE WHEN l_linenumber % 2 = 0 THEN 'low' ELSE NULL END AS confidence
        FROM {lineitem}""",
    "payload_assessments_v": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE extract(month FROM l_shipdate) || '/' || extract(day FROM l_shipdate) END AS said,
               CASE l_suppkey % 5 WHEN 0 THEN 'Problem Set' WHEN 1 THEN 'EXAM' WHEN 2 THEN 'unknown' WHEN 3 THEN 'paper' ELSE NULL END AS kind,
               CASE WHEN l_quantity > 40 THEN '' ELSE 'Item ' || l_partkey END AS title,
               CASE l_linenumber % 3 WHEN 0 THEN '0.25' WHEN 1 THEN 'a lot' ELSE NULL END AS weight
        FROM {lineitem}""",
    "extraction_a_v": """
        SELECT id, user_id, course_id, CASE WHEN kind = 'lecture' THEN 'meeting' ELSE 'assessment' END AS section, due, kind, topic AS title, weight FROM {schedule_v}""",
    "extraction_b_v": """
        SELECT id, user_id, course_id, section, due, kind, CASE WHEN id % 11 = 0 THEN title || ' (moved)' ELSE ' ' || upper(title) END AS title,
               CASE WHEN id % 13 = 0 THEN weight + 0.1 ELSE weight END AS weight FROM {extraction_a_v} WHERE id % 7 <> 0""",
    "link_rows_v": """
        SELECT user_id, chunk_id AS row_id, course_id,
               CASE WHEN chunk_id % 31 = 0 THEN '  ' WHEN chunk_id % 29 = 0 THEN 'zzz qqq' ELSE chapter_title || ' (ch. ' || (chunk_id % 25) || ')' END AS query
        FROM {chunks_v}""",
    "meeting_texts_v": """
        SELECT c_custkey AS id, 'u' || (c_custkey % 20) AS user_id, 'c' || (c_nationkey % 6 + 1) AS course_id,
               CASE c_custkey % 9 WHEN 0 THEN 'MW' WHEN 1 THEN 'TR' WHEN 2 THEN 'Mon/Wed' WHEN 3 THEN 'MTWRF' WHEN 4 THEN 'Tue, Thu'
                    WHEN 5 THEN 'TuTh' WHEN 6 THEN '' WHEN 7 THEN 'thursday' ELSE 'xx yy' END AS days,
               CASE c_custkey % 7 WHEN 0 THEN '2:00 pm' WHEN 1 THEN '9:00am' WHEN 2 THEN '14:05' WHEN 3 THEN '7 p.m.' WHEN 4 THEN 'noon' WHEN 5 THEN '12:30 AM' ELSE '' END AS start_time,
               c_mktsegment AS location, CASE WHEN c_custkey % 2 = 0 THEN 'Section ' || c_nationkey ELSE '' END AS label
        FROM {customer}""",
    "key_dates_v": """
        SELECT o_orderkey AS id, 'u' || (o_custkey % 20) AS user_id, 'c' || (o_orderkey % 7 + 1) AS course_id, 'Event ' || o_orderkey AS title,
               CASE WHEN o_orderkey % 6 = 0 THEN 'soon' WHEN o_orderkey % 41 = 0 THEN '1998-02-30' ELSE ' ' || CAST(CAST(o_orderdate AS DATE) AS STRING) END AS said,
               CASE o_orderkey % 4 WHEN 0 THEN 'Exam' WHEN 1 THEN 'project' WHEN 2 THEN 'party' ELSE NULL END AS kind
        FROM {orders}""",
    "terms_v": """
        SELECT user_id, course_id, CASE WHEN MIN(id) % 3 = 0 THEN DATE '1998-01-12' END AS term_start, CASE WHEN MIN(id) % 2 = 0 THEN DATE '1998-05-30' END AS term_end
        FROM {meeting_texts_v} GROUP BY user_id, course_id""",
    "syllabus_files_v": """
        SELECT doc_id, 'u' || (doc_id % 3) AS user_id, lang AS course_id,
               CASE lang WHEN 'fr' THEN 'CALC 2' WHEN 'es' THEN 'Seminar' WHEN 'de' THEN 'CSCI 303' ELSE 'ECON 303' END AS code,
               CASE lang WHEN 'fr' THEN 'Calculus II' WHEN 'de' THEN 'Computer Science' ELSE 'Economics' END AS course_title,
               'f' || doc_id AS source_id,
               CASE doc_id % 5 WHEN 0 THEN 'Syllabus.pdf' WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'Course_Outline.md' ELSE 'file' || doc_id || '.txt' END AS file_name,
               doc_id % 8 = 0 AS explicit,
               CASE doc_id % 6 WHEN 0 THEN 'CSCI 243 ' WHEN 1 THEN 'ECON 303 Syllabus and grading policy. ' WHEN 2 THEN 'ECON 101 ' WHEN 3 THEN 'MATH 112 syllabus, course outline ' WHEN 4 THEN 'HIST 303 ' ELSE '' END || text AS text
        FROM {documents}""",
    # --- schedule, engagement, calendar ------------------------------------------
    "schedule_v": """
        SELECT o_orderkey AS id, 'u' || (o_custkey % 20) AS user_id,
               'c' || substr(o_orderpriority, 1, 1) AS course_id,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due,
               CASE o_orderstatus WHEN 'F' THEN 'lecture' WHEN 'O' THEN 'due' ELSE 'exam' END AS kind,
               'Topic ' || (o_orderkey % 97) AS topic, o_custkey % 3 = 0 AS needs_review,
               (o_orderkey % 4) / 4.0 AS weight
        FROM {orders}""",
    "schedule_refs_v": """
        SELECT DISTINCT l_orderkey AS id,
               'c' || (l_partkey % 50 % 5 + 1) || ':s' || (l_partkey % 50 % 7) || ':' || (l_partkey % 50) AS chapter_ref
        FROM {lineitem}""",
    "assessments_v": """
        SELECT id, user_id, course_id, due, kind, topic AS title, weight,
               CASE id % 3 WHEN 0 THEN 'not_started' WHEN 1 THEN 'in_progress' ELSE 'done' END AS status,
               id % 5 = 0 AS user_entered
        FROM {schedule_v} WHERE kind <> 'lecture'""",
    "engagement_ev_v": """
        SELECT event_id, 'u' || (user_id % 20) AS user_id,
               'c' || (k % 50 % 5 + 1) || ':s' || (k % 50 % 7) || ':' || (k % 50) AS chapter_ref,
               CASE WHEN event_type IN ('view', 'click') THEN 'question' WHEN event_type = 'purchase' THEN 'ps_hit'
                    WHEN event_type = 'signup' THEN 'export' ELSE 'other' END AS kind, ts
        FROM (SELECT event_id, user_id, event_type, ts,
                     CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e""",
    "manual_v": """
        SELECT event_id, user_id, chapter_ref, value / 50.0 - 0.2 AS progress, e_ts AS ts
        FROM (SELECT v.event_id, v.user_id, v.chapter_ref, e.value, e.ts AS e_ts
              FROM {engagement_ev_v} v JOIN {events} e ON e.event_id = v.event_id WHERE v.kind = 'other') m""",
    "library_v": """
        SELECT p_partkey AS chunk_id, 'u' || (p_partkey % 20) AS user_id,
               'c' || (p_partkey % 50 % 5 + 1) AS course_id, 's' || (p_partkey % 50 % 7) AS source_id,
               p_partkey % 50 AS chapter_num, p_partkey AS ordinal,
               CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS chapter_title,
               p_size AS page_start, p_size + p_partkey % 4 AS page_end
        FROM {part}""",
    "calendar_events_v": """
        SELECT c_custkey AS id, 'u' || (c_custkey % 20) AS user_id, 'c' || (c_nationkey % 5 + 1) AS course_id,
               c_name AS title, CASE c_custkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'club' WHEN 2 THEN 'project' ELSE 'custom' END AS kind,
               DATE '1998-04-20' + CAST(c_custkey % 80 AS INT) AS event_date,
               CASE WHEN c_custkey % 3 = 0 THEN 'weekly' ELSE 'none' END AS recurrence,
               CASE c_nationkey % 4 WHEN 0 THEN 'MO,WE,FR' WHEN 1 THEN 'TU,TH' WHEN 2 THEN 'SA' ELSE '' END AS recur_days,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '1998-06-01' + CAST(c_custkey % 60 AS INT) END AS recur_until,
               CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '09:00' ELSE '14:30' END AS start_time,
               c_custkey % 11 = 0 AS done
        FROM {customer}""",
    "task_status_v": """
        SELECT 'u' || (user_id % 20) AS user_id,
               CASE WHEN k % 2 = 0 THEN 'sched:' || (event_id % 5000) ELSE 'event:' || (event_id % 500) END AS item_id,
               event_type <> 'error' AS done, ts, event_id
        FROM (SELECT event_id, user_id, event_type, ts,
                     CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e""",
    "runs_v": """
        SELECT event_id AS run_id, 'u' || (user_id % 20) AS user_id, event_type = 'error' AS refused,
               CAST(floor(value * 1000) AS BIGINT) AS latency_ms, ts AS ran_at FROM {events}""",
    # --- practice and grades ---------------------------------------------------------
    "problems_v": """
        SELECT p_partkey AS problem_id, 'u' || (p_partkey % 20) AS user_id, 'c' || (p_size % 5 + 1) AS course_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'uploaded' ELSE 'generated' END AS origin,
               p_size AS number, p_type AS topic,
               'c' || (p_partkey % 50 % 5 + 1) || ':s' || (p_partkey % 50 % 7) || ':' || (p_partkey % 50) AS chapter_ref,
               p_partkey % 3 <> 0 AND p_size % 4 <> 0 AS verified
        FROM {part}""",
    "attempts_v": """
        SELECT 'u' || (l_partkey % 20) AS user_id, l_partkey AS problem_id, l_returnflag <> 'R' AS correct,
               l_linenumber - 2 AS help_level, l_shipdate AS ts, l_orderkey FROM {lineitem}""",
    "answers_v": """
        SELECT l_orderkey AS test_id, l_partkey AS problem_id,
               CASE WHEN l_linenumber = 7 THEN '' ELSE 'x1 = ' || l_quantity || ', x2 = ' || (l_extendedprice / 1000) END AS expected,
               CASE l_suppkey % 5 WHEN 0 THEN 'x1=' || l_quantity || '; x2 = ' || (l_extendedprice / 1000) WHEN 1 THEN 'x1 = ' || (l_quantity * 1.0005) || ' x2=' || (l_extendedprice / 1000)
                    WHEN 2 THEN 'x1 = ' || (l_quantity * 1.01) || ', x2 = ' || (l_extendedprice / 1000) WHEN 3 THEN 'x1 = 1, x2 = 2, x1 = ' || l_quantity ELSE NULL END AS entered
        FROM {lineitem}""",
    "keyed_v": """
        SELECT id, template, type, a, b, m, p1, p2, qa, qb, p0, c, w, r, q,
               CASE template WHEN 'cobb_douglas_utility_max' THEN a * m / ((a + b) * p1) WHEN 'budget_line' THEN m / p1 WHEN 'price_elasticity' THEN qa - qb * p0
                    WHEN 'profit_max_monopoly' THEN (qa - c) / (2 * qb) ELSE power(q / power(a * r / (b * w), a), 1 / (a + b)) * a * r / (b * w) END * slip AS claim1,
               CASE template WHEN 'cobb_douglas_utility_max' THEN b * m / ((a + b) * p2) WHEN 'budget_line' THEN m / p2 WHEN 'price_elasticity' THEN -qb * p0 / (qa - qb * p0)
                    WHEN 'profit_max_monopoly' THEN qa - (qa - c) / 2 ELSE power(q / power(a * r / (b * w), a), 1 / (a + b)) END AS claim2
        FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 7 AS kindno,
                CASE l_suppkey % 7 WHEN 0 THEN 'cobb_douglas_utility_max' WHEN 1 THEN 'budget_line' WHEN 2 THEN 'price_elasticity' WHEN 3 THEN 'profit_max_monopoly' WHEN 4 THEN 'cost_minimization' ELSE 'none' END AS template,
                CASE l_linenumber % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'short_answer' ELSE 'symbolic' END AS type,
                0.25 + l_discount AS a, 0.5 + l_tax AS b, l_extendedprice AS m, 1.0 + l_quantity AS p1, 2.0 + l_linenumber AS p2, 1000.0 + l_quantity AS qa, 1.5 + l_tax AS qb, 3.0 + l_linenumber AS p0,
                CASE WHEN l_linenumber = 6 THEN NULL ELSE 20.0 + l_linenumber END AS c, 4.0 + l_tax AS w, 2.0 + l_discount AS r, l_quantity AS q,
                CASE WHEN l_partkey % 4 = 0 THEN 1.02 ELSE 1.0 END AS slip FROM {lineitem}) k""",
    "raw_problems_v": """
        SELECT doc_id, source AS source_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ' ' || doc_id || '(b) and more text' END AS number,
               CASE WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS prompt,
               CASE doc_id % 6 WHEN 0 THEN 'Symbolic Derivation' WHEN 1 THEN 'multiple-choice' WHEN 2 THEN 'riddle' WHEN 3 THEN NULL WHEN 4 THEN 'PROOF' ELSE 'essay prompt' END AS type,
               split_part(text, chr(10), 1) AS topic, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ' Hard ' END AS difficulty, lang AS given_solution,
               CASE doc_id % 5 WHEN 0 THEN '0.4' WHEN 1 THEN 'high' WHEN 2 THEN NULL ELSE '0.9' END AS confidence
        FROM {documents}""",
    "help_requests_v": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'uploaded' ELSE 'generated' END AS origin, CAST(doc_id % 6 AS INT) AS level,
               replace(text, '.' || chr(10), '. So 3 * 4 of it. Therefore this is true.' || chr(10)) || ' The answer is 7. x = 12! Done.' AS text
        FROM {documents}""",
    "scores_v": """
        SELECT l_orderkey AS student, l_returnflag AS component, item, l_quantity AS quantity,
               CASE WHEN l_linestatus = 'O' AND item % 2 = 0 THEN NULL ELSE 2.0 * l_quantity END AS score
        FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity,
                     row_number() OVER (PARTITION BY l_orderkey
                         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS item
              FROM {lineitem}) s""",
    "grade_components_v": """
        SELECT student, component, n_items,
               CASE WHEN n_comp = 3 THEN CASE component WHEN 'A' THEN CAST(0.3 AS DOUBLE) WHEN 'N' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END
                    ELSE CAST(1 AS DOUBLE) / n_comp END * CASE WHEN student % 11 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight,
               CASE WHEN component = 'N' THEN 'weighted' ELSE 'equal' END AS aggregation,
               CASE WHEN (component = 'A' OR student % 5 = 0) AND n_items >= 3 THEN 1 ELSE 0 END AS drop_lowest,
               CASE WHEN component = 'A' AND n_items >= 4 AND student % 2 = 0 THEN 1 ELSE 0 END AS drop_highest
        FROM (SELECT student, component, COUNT(*) AS n_items, COUNT(*) OVER (PARTITION BY student) AS n_comp FROM {scores_v} GROUP BY student, component) c""",
    "grade_items_v": """
        SELECT student, component, item, score,
               CASE WHEN component = 'N' THEN CAST(2 AS DOUBLE) * row_number() OVER (PARTITION BY student, component ORDER BY item)
                    / (COUNT(*) OVER (PARTITION BY student, component) * (COUNT(*) OVER (PARTITION BY student, component) + 1)) END AS share
        FROM {scores_v}""",
    "grade_rules_v": """
        SELECT student, MIN(item) AS source_item, 'A' AS target, student % 3 <> 0 AS if_higher FROM {scores_v} WHERE component = 'R' GROUP BY student HAVING COUNT(*) = 1""",
    "grade_extra_v": """
        SELECT DISTINCT student, 1000 AS item, CAST(2 AS DOUBLE) AS points, CASE WHEN student % 8 = 0 THEN CAST(50 AS DOUBLE) END AS score FROM {scores_v} WHERE student % 4 = 0""",
    "hypothetical_v": """
        SELECT student, CASE WHEN student % 9 = 0 THEN item + 500 ELSE item END AS item, CAST(60 AS DOUBLE) + item * 7 AS value FROM {scores_v} WHERE score IS NULL""",
    "rule_components_v": """
        SELECT student, component AS component_id, CASE WHEN student % 17 = 0 THEN 'Exams' WHEN student % 23 = 0 THEN ' ' ELSE component END AS name,
               CASE WHEN student % 13 = 0 THEN weight * 5 ELSE weight END AS weight, CASE WHEN student % 19 = 0 THEN 'curve' ELSE aggregation END AS aggregation,
               CASE WHEN student % 29 = 0 THEN 3 ELSE drop_lowest END AS drop_lowest, drop_highest FROM {grade_components_v}""",
    "rule_items_v": """
        SELECT student, component AS component_id, CASE WHEN student % 7 = 0 THEN 'Item ' || (item % 4) ELSE component || item END AS name,
               CASE WHEN student % 10 = 0 THEN CAST(item AS DOUBLE) / 3 ELSE share END AS share, item FROM {grade_items_v}""",
    "rule_replacements_v": """
        SELECT student, CASE WHEN student % 6 = 0 THEN 'Lost' ELSE 'R' || source_item END AS source_name, CASE WHEN student % 4 = 0 THEN 'r' ELSE 'a' END AS target_name FROM {grade_rules_v}""",
    "rule_letters_v": """
        SELECT DISTINCT student, CASE WHEN student % 21 = 0 THEN ' ' ELSE component END AS letter, CASE WHEN student % 14 = 0 THEN CAST(120 AS DOUBLE) ELSE CAST(90 AS DOUBLE) END AS minimum, component FROM {scores_v}""",
    # --- tables of the deletion operators: user_id, row_id and the tie to a course -----------
    "del_sources_v": """
        SELECT DISTINCT user_id, course_id, source_id, source_id AS row_id,
               CASE CAST(substr(source_id, 2) AS INT) % 6 WHEN 0 THEN 'textbook' WHEN 1 THEN 'slides' WHEN 2 THEN 'syllabus' WHEN 3 THEN 'assessment' WHEN 4 THEN 'bbplus' ELSE 'readings' END AS type,
               CASE WHEN source_id = 's5' THEN '/up/Course_Outline.pdf' ELSE '/up/' || source_id || '.pdf' END AS file
        FROM {library_v} WHERE user_id <> 'u11'""",
    "del_chunks_v": "SELECT user_id, course_id, source_id, chunk_id AS row_id FROM {library_v}",
    "del_chapters_v": "SELECT DISTINCT user_id, course_id, source_id, source_id || '/' || chapter_num AS row_id FROM {library_v}",
    "del_parents_v": "SELECT DISTINCT user_id, source_id, source_id || '/p' || (chunk_id % 40) AS row_id FROM {library_v}",
    "del_schedule_v": "SELECT user_id, course_id, id AS row_id FROM {schedule_v}",
    "del_assessments_v": "SELECT user_id, course_id, id AS row_id FROM {assessments_v}",
    "del_calendar_events_v": "SELECT user_id, course_id, id AS row_id, CASE WHEN id % 2 = 0 THEN 'from syllabus' ELSE '' END AS notes FROM {calendar_events_v}",
    "del_grade_records_v": "SELECT 'u' || (student % 20) AS user_id, 'c' || (student % 6 + 1) AS course_id, student || '/' || item AS row_id FROM {scores_v}",
    "del_task_status_v": "SELECT DISTINCT user_id, item_id AS row_id FROM {task_status_v}",
    "del_study_plans_v": "SELECT user_id, id AS row_id, id AS assessment_id FROM {assessments_v}",
    "del_problems_v": "SELECT user_id, course_id, problem_id AS row_id, 's' || (problem_id % 9) AS source_id FROM {problems_v}",
    "del_attempts_v": """
        SELECT DISTINCT 'u' || (l_suppkey % 20) AS user_id, l_partkey AS problem_id, 'c' || (l_partkey % 5 + 1) || ':s1:' || (l_partkey % 50) AS chapter_ref, l_orderkey || '/' || l_partkey AS row_id FROM {lineitem}""",
    "del_engagement_v": "SELECT DISTINCT user_id, chapter_ref, chapter_ref AS row_id FROM {engagement_ev_v}",
    "del_manual_progress_v": "SELECT DISTINCT user_id, chapter_ref, chapter_ref AS row_id FROM {manual_v}",
    "del_conversations_v": "SELECT DISTINCT 'u' || (conv_id % 20) AS user_id, 'c' || (conv_id % 5 + 1) AS course_id, conv_id AS row_id FROM {conversations}",
    "del_messages_v": "SELECT 'u' || (conv_id % 20) AS user_id, conv_id AS conversation_id, conv_id || '.' || turn AS row_id FROM {conversations}",
    "del_artifacts_v": "SELECT user_id, row_id AS message_id, row_id || '.a' AS row_id FROM {del_messages_v}",
    "del_ingest_jobs_v": "SELECT user_id, 'c' || (page_id % 5 + 1) AS course_id, page_id AS row_id FROM {files_v}",
    "del_agent_runs_v": "SELECT user_id, 'c' || (run_id % 5 + 1) AS course_id, run_id AS row_id FROM {runs_v}",
    "del_requests_v": """
        SELECT DISTINCT CASE WHEN c_custkey % 20 = 19 THEN 'benchmark' ELSE 'u' || (c_custkey % 20) END AS user_id, 'c' || (c_custkey % 20 % 5 + 1) AS course_id,
               CASE c_custkey % 4 WHEN 0 THEN 'materials' WHEN 1 THEN 'syllabus' WHEN 2 THEN 'assessment_uploads' ELSE 'entire_course' END AS scope
        FROM {customer}""",
}


def _dependencies(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def binding_ctes(sql: str) -> str:
    """`sql` with the CTEs of every binding it names put in front."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed or name not in BINDINGS:
            return
        for dep in _dependencies(BINDINGS[name]):
            visit(dep)
        needed.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    parts = [f"{name} AS ({re.sub(r'[{}]', '', BINDINGS[name])})" for name in needed]
    if not parts:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(parts)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return head + ",\n" + body[4:]
    return head + "\n" + body


class Tables:
    """Base tables of one folder and the bindings over them, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder)
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in BINDINGS:
                sql = BINDINGS[name]
                inputs = {dep: self(dep) for dep in _dependencies(sql)}
                self._built[name] = self.spark.sql(sql, **inputs)
            elif name in BASE_TABLES:
                self._built[name] = self._read(name)
            else:
                raise KeyError(name)
        return self._built[name]

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_small(df) if name == "documents" else df

    def spread(self, name: str) -> DataFrame:
        """Like a call, for CPU-bound work on a table or binding that may come from one small file."""
        return spread_small(self(name))


def spread_small(df: DataFrame) -> DataFrame:
    """An input of fewer splits than cores is spread over the cores; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
