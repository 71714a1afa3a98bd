"""Streaming queries: the stream runs over all available files and its result equals the batch SQL."""

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.session import work_folder
from lectern.streaming import jobs as L


def drain(t, stream, job):
    """Run a job's stream to its end and read its report."""
    folder = work_folder(t.spark, "stream")
    L.run_job(stream, job, f"{folder}/sums", f"{folder}/state").awaitTermination()
    return L.report(stream, job, f"{folder}/sums")


def events(t):
    e = L.table_stream(t.spark, t.folder, "events")
    return e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))


_KIND = """CASE WHEN event_type IN ('view', 'click') THEN 'question' WHEN event_type = 'purchase' THEN 'ps_hit' WHEN event_type = 'signup' THEN 'export' ELSE 'other' END"""


@query("stream_engagement", f"""SELECT user_id, chapter_ref, COUNT(*) FILTER (kind = 'question') AS questions, COUNT(*) FILTER (kind = 'ps_hit') AS ps_hits, COUNT(*) FILTER (kind = 'export') AS exports
    FROM (SELECT DISTINCT 'u' || (user_id % 20) AS user_id, event_id, 'c' || (k % 7) AS chapter_ref, kind FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, {_KIND} AS kind FROM events)) GROUP BY ALL""")
def stream_engagement(t):
    e = events(t).select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"), F.col("event_id").alias("question_id"),
        F.concat(F.lit("c"), (F.col("k") % 7).cast("string")).alias("chapter_ref"), F.expr(_KIND).alias("kind"), "ts",
    )
    return drain(t, e, L.engagement())


@query("stream_job_progress", """SELECT user_id AS job_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS file_id, arg_max(event_type, (ts, event_id)) AS stage, MAX(event_id % 100) AS pages_done, COUNT(*) AS n_patches FROM events GROUP BY ALL""")
def stream_job_progress(t):
    patches = events(t).select(
        F.col("user_id").alias("job_id"), (F.col("k") % 10).alias("file_id"), F.col("event_type").alias("stage"),
        (F.col("event_id") % 100).alias("pages_done"), "ts", F.col("event_id").alias("seq"),
    )
    return drain(t, patches, L.job_progress())


@query("stream_ingest_dedupe", """WITH f AS (SELECT DISTINCT 'u' || (user_id % 20) AS user_id, event_type AS course_id, md5(props) AS file_hash FROM events),
    known AS (SELECT 'u' || (doc_id % 20) AS user_id, 'click' AS course_id, md5('{"k": ' || (doc_id % 100) || '}') AS file_hash FROM labels)
    SELECT user_id, course_id, file_hash FROM f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = f.user_id AND k.course_id = f.course_id AND k.file_hash = f.file_hash)""")
def stream_ingest_dedupe(t):
    files = events(t).select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"), F.col("event_type").alias("course_id"), F.md5(F.col("props").cast("binary")).alias("file_hash"), "ts"
    )
    props = F.concat(F.lit('{"k": '), (F.col("doc_id") % 100).cast("string"), F.lit("}"))
    known = t("labels").select(
        F.concat(F.lit("u"), (F.col("doc_id") % 20).cast("string")).alias("user_id"), F.lit("click").alias("course_id"), F.md5(props.cast("binary")).alias("file_hash")
    )
    return drain(t, files, L.ingest_dedupe(known))


def _runs(t):
    return events(t).select(
        F.col("ts").alias("ran_at"), (F.col("event_type") == "error").alias("refused"), F.floor(F.col("value") * 1000).cast("long").alias("latency_ms")
    )


_WINDOW = """SELECT strftime({start}, '%Y-%m-%d %H:%M:%S') AS start, strftime({start} + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS "end", COUNT(*) AS n, COUNT(*) FILTER (event_type = 'error') AS refused_n,
    round(SUM(CAST(floor(value * 1000) AS BIGINT))::DOUBLE / COUNT(*), 4) AS latency_mean, MAX(CAST(floor(value * 1000) AS BIGINT)) AS latency_max FROM {source} GROUP BY {start}"""


def _spelled(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("stream_run_windows", _WINDOW.format(start="date_trunc('day', ts)", width="1 DAY", source="events"))
def stream_run_windows(t):
    return _spelled(drain(t, _runs(t), L.run_windows()))


@query("stream_run_windows_sliding", _WINDOW.format(start="s", width="2 DAY", source="(SELECT *, date_trunc('day', ts) AS s FROM events UNION ALL SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY FROM events)"))
def stream_run_windows_sliding(t):
    return _spelled(drain(t, _runs(t), L.run_windows("2 days", "1 day")))


@query("attempt_sessions", """WITH a AS (SELECT 'u' || user_id AS user_id, ts, event_type = 'purchase' AS correct FROM events WHERE event_type IN ('purchase', 'error')),
    g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, SUM(starts) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(MAX(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", COUNT(*) AS n, COUNT(*) FILTER (correct) AS n_correct FROM s GROUP BY user_id, no""")
def attempt_sessions(t):
    attempts = events(t).where("event_type IN ('purchase', 'error')").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), "ts", (F.col("event_type") == "purchase").alias("correct")
    )
    return _spelled(drain(t, attempts, L.sessions()))
