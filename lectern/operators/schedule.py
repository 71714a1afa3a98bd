"""Engagement, readiness, pace, calendar and feeds of all users, as of a given date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions.common import exact_avg, ratio, top_rows

# --- engagement -----------------------------------------------------------------------------


def engagement_counters(events: DataFrame) -> DataFrame:
    """Counters per user and chapter from the event log (kind: question | ps_hit | export)."""
    counted = events.where(F.col("kind").isin("question", "ps_hit", "export"))
    return counted.groupBy("user_id", "chapter_ref").agg(
        F.count_if(F.col("kind") == "question").alias("questions"),
        F.count_if(F.col("kind") == "ps_hit").alias("ps_hits"),
        F.count_if(F.col("kind") == "export").alias("exports"),
        F.max("ts").alias("last_touched"),
    )


def engagement_score(questions: Column, ps_hits: Column, exports: Column) -> Column:
    raw = questions + V.ENGAGEMENT_PS_WEIGHT * ps_hits + V.ENGAGEMENT_EXPORT_WEIGHT * exports
    return F.least(F.lit(1.0), raw / V.ENGAGEMENT_SATURATION)


def engagement_status(score: Column) -> Column:
    return F.when(score >= V.READINESS_ENGAGED, "engaged").when(score > 0, "partial").otherwise("none")


def scored_engagement(counters: DataFrame) -> DataFrame:
    score = engagement_score(F.col("questions"), F.col("ps_hits"), F.col("exports"))
    return counters.withColumn("score", score).withColumn("status", engagement_status(F.col("score")))


def manual_latest(entries: DataFrame) -> DataFrame:
    """Latest self-reported progress per user and chapter, clamped to [0, 1]."""
    last = entries.groupBy("user_id", "chapter_ref").agg(F.max_by("progress", F.struct("ts", "event_id")).alias("progress"))
    return last.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))))


def chapter_labels(chunks: DataFrame) -> DataFrame:
    """(user_id, source_id, chapter_num, label): first non-empty title of each chapter with material."""
    return chunks.where("chapter_title <> ''").groupBy("user_id", "source_id", "chapter_num").agg(
        F.min_by("chapter_title", "ordinal").alias("title")
    )


def chapter_readiness(refs: DataFrame, counters: DataFrame, manual: DataFrame, chunks: DataFrame) -> DataFrame:
    """Readiness of each (user_id, chapter_ref): derived score, self-report, status and label."""
    key = ["user_id", "chapter_ref"]
    parts = F.split("chapter_ref", ":")
    wanted = refs.select(*key).distinct().withColumns(
        {
            "course_id": F.try_element_at(parts, F.lit(1)),
            "source_id": F.try_element_at(parts, F.lit(2)),
            "chapter_num": F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("long"), F.lit(0)),
        }
    )
    zero = F.lit(0).cast("long")
    out = wanted.join(counters, key, "left").join(manual, key, "left")
    out = out.join(chapter_labels(chunks), ["user_id", "source_id", "chapter_num"], "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("questions", "ps_hits", "exports")})
    derived = F.round(engagement_score(F.col("questions"), F.col("ps_hits"), F.col("exports")), 3)
    return out.select(
        *key, "course_id", "chapter_num",
        F.coalesce("title", F.concat(F.lit("Ch "), F.col("chapter_num").cast("string"))).alias("label"),
        derived.alias("derived"), F.round("progress", 3).alias("manual"), engagement_status(derived).alias("status"),
        "questions", "ps_hits", "exports", F.col("title").isNotNull().alias("has_materials"),
    )


def engagement_report(chunks: DataFrame, counters: DataFrame, manual: DataFrame) -> DataFrame:
    refs = chunks.select("user_id", F.concat_ws(":", "course_id", "source_id", F.col("chapter_num").cast("string")).alias("chapter_ref"))
    return chapter_readiness(refs, counters, manual, chunks)


# --- exams -------------------------------------------------------------------------------------


def schedule_range(schedule: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows in a date range; any bound leaves out undated rows. Undated rows sort last."""
    out = schedule
    if start is not None:
        out = out.where(F.col("due") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("due") <= F.lit(end))
    return out.orderBy(F.asc_nulls_last("due"), "id")


def next_exam(schedule: DataFrame, as_of: date) -> DataFrame:
    """Next exam of each user with its distance; aggregated map-side, no window over a user."""
    ahead = schedule.where((F.col("due") >= F.lit(as_of)) & (F.col("kind") == "exam"))
    first = ahead.groupBy("user_id").agg(F.min(F.struct("due", "id", "course_id", "topic")).alias("e"))
    return first.select(
        "user_id", F.col("e.id").alias("id"), F.col("e.course_id").alias("course_id"), F.col("e.topic").alias("topic"),
        F.col("e.due").alias("due"), F.date_diff(F.col("e.due"), F.lit(as_of)).alias("days_away"),
    )


def exam_chapters(exams: DataFrame, refs: DataFrame, counters: DataFrame, manual: DataFrame, chunks: DataFrame) -> DataFrame:
    """Readiness of the chapters each user's next exam covers."""
    covered = exams.select("user_id", "id", "days_away").join(refs, "id")
    ready = chapter_readiness(covered, counters, manual, chunks)
    return covered.join(ready, ["user_id", "chapter_ref"])


def exam_readiness(exams: DataFrame, chapters: DataFrame) -> DataFrame:
    overall = chapters.groupBy("user_id", "id").agg(F.count("*").alias("n_chapters"), F.round(exact_avg(F.col("derived")), 3).alias("overall"))
    out = exams.join(overall, ["user_id", "id"], "left")
    return out.withColumns({"n_chapters": F.coalesce("n_chapters", F.lit(0)), "overall": F.coalesce("overall", F.lit(0.0))})


def study_plan(chapters: DataFrame) -> DataFrame:
    """Chapters of an exam spread over the days left, least engaged first; the last day is light."""
    ahead = chapters.where("days_away > 0")
    order = Window.partitionBy("user_id", "id").orderBy("derived", F.desc("questions"), "course_id", "chapter_num", "chapter_ref")
    exam = Window.partitionBy("user_id", "id")
    placed = ahead.withColumns({"place": F.row_number().over(order) - 1, "n": F.count("*").over(exam)})
    days = F.greatest(F.lit(1), F.greatest(F.lit(1), F.least(F.col("days_away"), F.lit(V.PLAN_MAX_DAYS))) - 1)
    per_day = F.greatest(F.lit(1), F.ceil(F.col("n") / days))
    planned = placed.withColumn("day", (F.floor(F.col("place") / per_day) + 1).cast("int"))
    planned = planned.withColumn("last_day", F.max("day").over(exam))
    return planned.select(
        "user_id", "id", "day", F.greatest(F.lit(1), F.col("days_away") - F.col("day") + 1).alias("days_before_exam"),
        "chapter_ref", "status", F.when(F.col("derived") == 0, "no engagement").otherwise("needs review").alias("reason"),
        F.when(F.col("day") == F.col("last_day"), "lighter load: review only").otherwise("").alias("note"),
    )


# --- week and today ---------------------------------------------------------------------------------


def week_view(users: DataFrame, schedule: DataFrame, refs: DataFrame, counters: DataFrame, as_of: date) -> DataFrame:
    """Seven days (Monday first) per user: items and mean engagement of the chapters they cover."""
    monday = F.date_trunc("week", F.lit(as_of)).cast("date")
    days = users.select("user_id", F.explode(F.sequence(monday, F.date_add(monday, 6))).alias("day"))
    rows = schedule.where(F.col("due").between(monday, F.date_add(monday, 6)))
    items = rows.groupBy("user_id", F.col("due").alias("day")).agg(F.count("*").alias("n_items"))
    covered = rows.select("user_id", F.col("due").alias("day"), "id").join(refs, "id").select("user_id", "day", "chapter_ref").distinct()
    scored = covered.join(scored_engagement(counters).select("user_id", "chapter_ref", "score"), ["user_id", "chapter_ref"], "left")
    engagement = scored.groupBy("user_id", "day").agg(
        F.count("*").alias("n_chapters"), F.round(exact_avg(F.coalesce("score", F.lit(0.0))), 3).alias("engagement")
    )
    out = days.join(items, ["user_id", "day"], "left").join(engagement, ["user_id", "day"], "left")
    return out.select(
        "user_id", "day", F.date_format("day", "E").alias("weekday"), (F.col("day") == F.lit(as_of)).alias("is_today"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), "engagement",
    )


def upcoming(schedule: DataFrame, as_of: date, days: int = V.UPCOMING_DAYS, limit: int = V.UPCOMING_ROWS) -> DataFrame:
    """The next exams and deadlines of each user."""
    ahead = schedule.where(
        F.col("due").between(F.date_add(F.lit(as_of), 1), F.date_add(F.lit(as_of), days)) & F.col("kind").isin("exam", "due")
    )
    out = top_rows(ahead, ["user_id"], [F.asc("due"), F.asc("id")], limit, "place")
    return out.withColumn("days_away", F.date_diff("due", F.lit(as_of)))


# --- pace -----------------------------------------------------------------------------------------------


def progress_report(schedule: DataFrame, refs: DataFrame, counters: DataFrame, as_of: date) -> DataFrame:
    """Class pace against the user's engagement per course.

    Undated lectures count towards the total and never to date.
    """
    key = ["user_id", "course_id"]
    lectures = schedule.where("kind = 'lecture'")
    so_far = F.coalesce(F.col("due") <= F.lit(as_of), F.lit(False))
    pace = lectures.groupBy(*key).agg(F.count("*").alias("meetings_total"), F.count_if(so_far).alias("meetings_to_date"))
    topics = lectures.where(so_far).select("id", *key).join(refs, "id").select(*key, "chapter_ref").distinct()
    scores = scored_engagement(counters).select("user_id", "chapter_ref", "score")
    engaged = F.coalesce(F.col("score") >= V.PROGRESS_ENGAGED, F.lit(False))
    topics = topics.join(scores, ["user_id", "chapter_ref"], "left").groupBy(*key).agg(
        F.count("*").alias("topics_to_date"), F.count_if(engaged).alias("topics_engaged")
    )
    out = pace.join(topics, key, "left")
    return _with_rates(out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("topics_to_date", "topics_engaged")}))


def _with_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "pace": F.round(ratio(F.col("meetings_to_date"), F.col("meetings_total")), 4),
            "progress": F.round(ratio(F.col("topics_engaged"), F.col("topics_to_date")), 4),
            "behind": F.greatest(F.lit(0), F.col("topics_to_date") - F.col("topics_engaged")),
        }
    )


def progress_rollup(report: DataFrame) -> DataFrame:
    """Per user totals with the rates taken again from the sums."""
    parts = ["meetings_total", "meetings_to_date", "topics_to_date", "topics_engaged"]
    return _with_rates(report.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in parts]))


# --- calendar ---------------------------------------------------------------------------------------------


def holidays(years: DataFrame) -> DataFrame:
    """(day, name) of the holiday rules for each year in `years`."""
    rules = []
    for name, month, rule in V.HOLIDAYS:
        first = F.make_date(F.col("year"), F.lit(month), F.lit(1))
        if isinstance(rule, int):
            day = F.make_date(F.col("year"), F.lit(month), F.lit(rule))
        elif rule[1] > 0:
            day = F.date_add(first, (F.lit(rule[0]) - F.weekday(first) + 7) % 7 + 7 * (rule[1] - 1))
        else:
            last = F.last_day(first)
            day = F.date_sub(last, (F.weekday(last) - rule[0] + 7) % 7)
        rules.append(F.struct(day.alias("day"), F.lit(name).alias("name")))
        if name == "Thanksgiving":
            rules.append(F.struct(F.date_add(day, 1).alias("day"), F.lit(V.THANKSGIVING_BREAK).alias("name")))
    return years.select(F.explode(F.array(*rules)).alias("h")).select("h.day", "h.name")


def expand_recurrence(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events with the days they fall on inside [start, end] as `day`."""
    weekly = (F.col("recurrence") == "weekly") & (F.coalesce("recur_days", F.lit("")) != "")
    low = F.greatest(start, F.coalesce("event_date", start))
    high = F.least(end, F.coalesce("recur_until", end))
    codes = F.array(*[F.lit(c) for c in V.WEEKDAY_CODES])
    wanted = F.split("recur_days", ",")
    span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<date>"))
    repeated = F.filter(span, lambda d: F.array_contains(wanted, F.element_at(codes, F.weekday(d) + 1)))
    single = F.filter(F.array("event_date"), lambda d: d.isNotNull() & d.between(start, end))
    return events.withColumn("day", F.explode(F.when(weekly, repeated).otherwise(single)))


def calendar_items(
    schedule: DataFrame, assessments: DataFrame, events: DataFrame, done: DataFrame, users: DataFrame, start: Column, end: Column
) -> DataFrame:
    """One list of dated items from schedule, assessments, events and holidays.

    `start` and `end` may be columns of `users`, which carries the range of each user.
    """
    ranges = users.select("user_id", start.alias("lo"), end.alias("hi"))
    within = F.col("due").between(F.col("lo"), F.col("hi"))
    kind = F.when(F.col("kind").isin("lecture", "class"), "concept").otherwise(F.col("kind"))

    def item(df: DataFrame, **columns: Column) -> DataFrame:
        order = ["user_id", "item_id", "day", "kind", "title", "course_id", "start_time", "source", "own_done", "check_off"]
        return df.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in order])

    no = F.lit(False)
    from_schedule = item(
        schedule.join(ranges, "user_id").where(within),
        item_id=F.concat(F.lit("sched:"), F.col("id").cast("string")), day=F.col("due"), kind=kind, title=F.col("topic"),
        start_time=F.lit(""), source=F.lit("syllabus"), own_done=no, check_off=F.lit(True),
    )
    from_assessments = item(
        assessments.join(ranges, "user_id").where(within),
        item_id=F.concat(F.lit("assess:"), F.col("id").cast("string")), day=F.col("due"), start_time=F.lit(""),
        source=F.lit("assessment"), own_done=F.col("status") == "done", check_off=no,
    )
    repeated = F.col("recurrence") == "weekly"
    occurrences = expand_recurrence(events.join(ranges, "user_id"), F.col("lo"), F.col("hi"))
    event_id = F.concat(F.lit("event:"), F.col("id").cast("string"))
    from_events = item(
        occurrences,
        item_id=F.when(repeated, F.concat(event_id, F.lit(":"), F.col("day").cast("string"))).otherwise(event_id),
        source=F.lit("event"), own_done=~repeated & F.col("done"), check_off=F.lit(True),
    )
    years = ranges.select("user_id", "lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("year"))
    named = holidays(years.select("year").distinct()).withColumn("year", F.year("day"))
    from_holidays = item(
        years.join(named, "year").where(F.col("day").between(F.col("lo"), F.col("hi"))),
        item_id=F.concat(F.lit("holiday:"), F.col("day").cast("string")), kind=F.lit("holiday"), title=F.col("name"),
        course_id=F.lit(""), start_time=F.lit(""), source=F.lit("holiday"), own_done=no, check_off=no,
    )
    merged = from_schedule.unionByName(from_assessments).unionByName(from_events).unionByName(from_holidays)
    checked = done.where("done").select("user_id", "item_id", F.lit(True).alias("checked"))
    out = merged.join(checked, ["user_id", "item_id"], "left")
    is_done = F.col("own_done") | (F.col("check_off") & F.coalesce("checked", F.lit(False)))
    return out.withColumn("done", is_done).drop("own_done", "check_off", "checked")


def in_calendar_order(items: DataFrame) -> DataFrame:
    return items.orderBy("user_id", "day", F.when(F.col("start_time") == "", "zz").otherwise(F.col("start_time")), "title", "item_id")


def term_bounds(users: DataFrame, schedule: DataFrame, assessments: DataFrame, events: DataFrame, as_of: date) -> DataFrame:
    """First and last dated item of each user, widened to today; 120 days either way without any."""
    dated = [
        schedule.select("user_id", F.col("due").alias("lo"), F.col("due").alias("hi")),
        assessments.select("user_id", F.col("due").alias("lo"), F.col("due").alias("hi")),
        events.select("user_id", F.least("event_date", "recur_until").alias("lo"), F.greatest("event_date", "recur_until").alias("hi")),
    ]
    merged = dated[0].unionByName(dated[1]).unionByName(dated[2])
    found = merged.groupBy("user_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    today = F.lit(as_of)
    out = users.join(found, "user_id", "left")
    return out.select(
        "user_id",
        F.when(F.col("lo").isNull(), F.date_sub(today, V.TERM_DEFAULT_DAYS)).otherwise(F.least("lo", today)).alias("term_start"),
        F.when(F.col("hi").isNull(), F.date_add(today, V.TERM_DEFAULT_DAYS)).otherwise(F.greatest("hi", today)).alias("term_end"),
    )


def calendar_progress(items: DataFrame, as_of: date) -> DataFrame:
    """Tasks and completed tasks of today, this week and the term, per user.

    `items` cover the term; one pass counts all three ranges.
    """
    monday = F.date_trunc("week", F.lit(as_of)).cast("date")
    work = items.where(F.col("kind").isin(V.TASK_KINDS))
    ranges = F.array_compact(
        F.array(
            F.when(F.col("day") == F.lit(as_of), "today"),
            F.when(F.col("day").between(monday, F.date_add(monday, 6)), "week"),
            F.lit("semester"),
        )
    )
    counted = work.withColumn("range", F.explode(ranges)).groupBy("user_id", "range").agg(
        F.count("*").alias("total"), F.count_if("done").alias("n_done")
    )
    return counted.withColumn("pct", F.bround(100 * F.col("n_done") / F.col("total")).cast("long"))


# --- lists and feeds ------------------------------------------------------------------------------------------


def assessment_list(assessments: DataFrame, as_of: date) -> DataFrame:
    overdue = F.coalesce(F.col("due") < F.lit(as_of), F.lit(False)) & (F.col("status") != "done")
    return assessments.withColumn("overdue", overdue).orderBy(F.asc_nulls_last("due"), "id")


def feed_alarms(assessments: DataFrame, refs: DataFrame) -> DataFrame:
    """Feed entries of dated open assessments: summary, covered chapters of exams, three alarms."""
    open_rows = assessments.where(F.col("due").isNotNull() & (F.col("status") != "done"))
    covered = refs.select("id", F.element_at(F.split("chapter_ref", ":"), -1).try_cast("int").alias("chapter"))
    exams = open_rows.where(F.col("kind").isin(V.EXAM_KINDS)).select("id")
    chapters = covered.join(exams, "id", "left_semi").groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("chapter")), lambda c: c.cast("string")), ", ").alias("covers")
    )
    label = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    summary = F.concat(F.lit("["), F.upper("course_id"), F.lit("] "), label, F.lit(": "), F.col("title"))
    out = open_rows.join(chapters, "id", "left").withColumn("days_before", F.explode(F.array(*[F.lit(d) for d in V.ALARM_DAYS])))
    return out.select(
        "id", "user_id", summary.alias("summary"), F.coalesce("covers", F.lit("")).alias("covers"), "days_before",
        F.date_sub("due", F.col("days_before")).alias("alarm_on"),
    )


def task_status_latest(changes: DataFrame) -> DataFrame:
    """Latest check-off per item; assessment items are routed to the assessment's own status."""
    last = changes.groupBy("user_id", "item_id").agg(F.max_by("done", F.struct("ts", "event_id")).alias("done"))
    target = F.when(F.col("item_id").startswith("assess:"), "assessment").otherwise("task")
    return last.withColumn("target", target)


def course_overview(chunks: DataFrame, sources: DataFrame, courses: DataFrame) -> DataFrame:
    """Chunk and source counts per course, with the sources by name."""
    key = ["user_id", "course_id"]
    sized = chunks.groupBy(*key).agg(F.count("*").alias("n_chunks"))
    named = sources.select(*key, "source_id").distinct().groupBy(*key).agg(
        F.count("*").alias("n_sources"), F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("sources")
    )
    out = courses.join(sized, key, "left").join(named, key, "left")
    return out.select(
        *key, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.col("n_chunks").isNotNull().alias("loaded"),
    )
