"""Schedule extraction, comparison of two extractions, and linking of rows to chapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import dates as D
from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.functions.common import any_case, ascii_edges, exact_avg, first_row, let, matches, once, sql_round, top_rows

CHAPTERS_PER_PACK = 64

# --- extraction ---------------------------------------------------------------------------


def reading_refs(rows: DataFrame, primaries: DataFrame, text: str = "reading") -> DataFrame:
    """Adds `refs`: the chapters a reading names, bound to the course's primary source.

    Without a primary source nothing can be bound and the list is empty.
    """
    main = primaries.select("user_id", "course_id", F.col("source_id").alias("_source"))
    joined = rows.join(main, ["user_id", "course_id"], "left")
    refs = F.transform(
        X.chapter_mentions(F.col(text)), lambda n: F.concat_ws(":", F.col("course_id"), F.col("_source"), n.cast("string"))
    )
    none = F.array().cast("array<string>")
    return joined.withColumn("refs", F.when(F.col("_source").isNull(), none).otherwise(refs)).drop("_source")


def schedule_lines(syllabi: DataFrame, keys: Sequence[str], default_year: int) -> DataFrame:
    """Dated schedule rows of line-oriented syllabi.

    The header facts (term start, meeting days) are read from the whole text of the same row, so
    they need no aggregation and no join.
    """
    text, year = F.col("text"), F.lit(default_year)
    prefixes = sorted({name[:3] for name in V.WEEKDAY_INDEX})
    named = F.split(F.lower(F.regexp_extract(text, any_case(V.MEETS_LINE), 1)), "[,/ ]+")
    days = F.slice(F.filter(named, lambda d: d.rlike("^(?:" + "|".join(prefixes) + ")")), 1, 4)
    started = F.regexp_extract(text, any_case(V.TERM_START_LINE), 1)
    headed = once(syllabi.select(*keys, "text", days.alias("meeting_days"), started.alias("started")), term_start=D.parse_date(F.col("started"), year))
    lines = headed.select(*keys, "term_start", "meeting_days", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = F.col("line")
    # each step looks at the lines that the step before left, at each of them once
    lines = once(lines, line=P.strip(F.col("raw"))).where(F.length("line") >= 6).drop("raw")
    lines = once(lines, aside=D.is_holiday(line) | matches(line, V.HEADER_LINE)).where("NOT aside").drop("aside")
    lines = once(lines, stated=D.parse_date(line, F.coalesce(F.year("term_start"), year)), week=F.regexp_extract(line, any_case(V.WEEK_REF), 1))
    week = F.when(F.col("week") != "", F.col("week").try_cast("int"))
    by_week = F.try_element_at(D.expand_week(week, F.col("term_start"), F.col("meeting_days")), F.lit(1))
    when = F.coalesce("stated", F.when(F.col("term_start").isNotNull() & (F.col("week") != ""), by_week))
    rows = once(lines, date=when).where("date IS NOT NULL")
    rows = once(rows, kind=D.row_kind(line), rest=P.strip(F.regexp_replace(line, r"^[^|]*\|", "")))
    kind, body = F.col("kind"), F.when(F.col("rest") == "", line).otherwise(F.col("rest"))
    item = (
        F.when(kind == "exam", F.when(matches(line, r"\bfinal\b"), "final").otherwise("midterm"))
        .when(kind == "due", F.when(matches(line, r"\b(paper|essay)\b"), "paper").otherwise("problem_set"))
        .otherwise("meeting")
    )
    low = (kind == "exam") | ((kind == "lecture") & (F.col("week") != ""))
    return rows.select(
        *keys, "line_no", "date", "kind", item.alias("item"),
        F.substring(body, F.lit(1), F.when(kind == "lecture", 120).otherwise(60)).alias("title"), body.alias("covers"),
        F.when(low, "low").otherwise("high").alias("confidence"),
    )


PAYLOAD = (
    "course STRUCT<code: STRING, title: STRING, term_start: STRING, term_end: STRING, meeting_days: ARRAY<STRING>>, "
    "meetings ARRAY<STRUCT<date: STRING, topic: STRING, readings: ARRAY<STRING>, confidence: STRING>>, "
    "assessments ARRAY<STRUCT<date: STRING, kind: STRING, covers: ARRAY<STRING>, weight: STRING, title: STRING, confidence: STRING>>"
)


def payload_rows(payloads: DataFrame, keys: Sequence[str], default_year: int, column: str = "payload") -> DataFrame:
    """Typed rows of JSON extraction payloads: section, position, date, kind, title, weight, confidence."""
    parsed = once(payloads.select(*keys, column), p=F.from_json(column, PAYLOAD))
    parsed = once(parsed, start=D.parse_date(F.col("p.course.term_start"), F.lit(default_year)))

    def entry(section: str, x: Column, pos: Column, kind: Column, title: Column, weight: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), pos.alias("pos"), x["date"].alias("said"), kind.alias("kind"), F.coalesce(title, F.lit("")).alias("title"),
            weight.alias("weight"), F.coalesce(x["confidence"], F.lit("high")).alias("confidence"),
        )

    # both sections leave the payload together, so it is made and parsed once
    m = F.transform("p.meetings", lambda x, i: entry("meeting", x, i, F.lit("lecture"), x["topic"], F.lit(None).cast("string")))
    a = F.transform("p.assessments", lambda x, i: entry("assessment", x, i, x["kind"], x["title"], x["weight"]))
    year = F.coalesce(F.year("start"), F.lit(default_year)).alias("year")
    rows = parsed.select(*keys, year, F.inline(F.flatten(F.array_compact(F.array(m, a)))))
    rows = once(rows, date=D.parse_date(F.col("said"), F.col("year")))
    met, titled = F.col("section") == "meeting", F.trim("title") != ""
    rows = rows.where(F.when(met, titled & ~D.is_holiday(F.col("title"))).otherwise(titled | F.col("date").isNotNull()))
    kind = F.replace(F.lower(F.coalesce("kind", F.lit("quiz"))), F.lit(" "), F.lit("_"))
    # a text without a digit is a number only by name; a cast finds out by an exception
    number = F.when(F.col("weight").rlike(r"(?i)[0-9]|inf|nan"), F.col("weight").try_cast("double"))
    return rows.select(
        *keys, "section", "pos", "date", F.when(met, "lecture").when(kind.isin(V.ASSESSMENT_KINDS), kind).otherwise("quiz").alias("kind"),
        "title", F.coalesce(number, F.lit(0.0)).alias("weight"), "confidence",
    )


# --- comparison of two extractions -------------------------------------------------------------


def extraction_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(conflicts, per-document agreement) of two extractions.

    Rows: keys, section (meeting | assessment), pos, date, kind, title, refs, weight. A meeting is
    matched on date and topic, an assessment on date, kind and the start of its title; repeated rows
    of one side count once, the last one.
    """
    keys = list(keys)
    title = F.lower(F.trim("title"))
    key = F.when(F.col("section") == "meeting", title).otherwise(F.concat_ws("|", "kind", F.substring(title, 1, 24)))
    match = [*keys, "section", "day", "match_key"]

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumns({"day": F.coalesce(F.col("date").cast("string"), F.lit("no-date")), "match_key": key})
        df = first_row(df, match, [F.desc("pos")])
        refs = F.array_sort(F.transform("refs", lambda r: F.lower(F.trim(r))))
        return df.select(*match, refs.alias(f"refs_{name}"), F.col("weight").alias(f"weight_{name}"), F.lit(True).alias(f"in_{name}"))

    both = side(a, "a").join(side(b, "b"), match, "full_outer")
    one_sided = F.col("in_a").isNull() | F.col("in_b").isNull()
    refs_differ = ~F.col("refs_a").eqNullSafe(F.col("refs_b"))
    weight_differs = (F.col("section") == "assessment") & ~F.col("weight_a").eqNullSafe(F.col("weight_b"))
    name = F.when(F.col("section") == "meeting", "chapter_refs").otherwise("covers")
    fields = F.array_compact(F.array(F.when(refs_differ, name), F.when(weight_differs, "weight")))
    judged = both.withColumn("fields", F.when(one_sided, F.array(F.lit("presence"))).otherwise(fields))
    conflicts = judged.select(*match, F.explode("fields").alias("field"))
    agreement = judged.groupBy(*keys).agg(
        F.count("*").alias("total_rows"), F.count_if(F.size("fields") == 0).alias("agreed_rows"), F.sum(F.size("fields")).alias("conflicts")
    )
    return conflicts, agreement


def agreement_rate(agreement: DataFrame) -> DataFrame:
    rate = F.when(F.col("total_rows") == 0, 1.0).otherwise(F.col("agreed_rows") / F.col("total_rows"))
    return agreement.withColumn("rate", F.round(rate, 4)).withColumn("needs_review", F.col("conflicts") > 0)


# --- linking ---------------------------------------------------------------------------------------


def pack_chapters(chapters: DataFrame) -> DataFrame:
    """(user_id, course_id, pack array): a course's chapters in packs of at most 64.

    `chapters`: user_id, course_id, source_id, chapter_num, title, embedding (unit or null).
    """
    place = Window.partitionBy("user_id", "course_id").orderBy("source_id", "chapter_num")
    numbered = chapters.withColumn("_place", F.row_number().over(place) - 1)
    entry = F.struct(
        F.col("_place").alias("place"), "source_id", "chapter_num", "title", X.title_tokens(F.col("title")).alias("words"), "embedding"
    )
    grouped = numbered.groupBy("user_id", "course_id", F.floor(F.col("_place") / CHAPTERS_PER_PACK).alias("pack_no"))
    return grouped.agg(F.collect_list(entry).alias("pack"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))
    )


def chapter_link(rows: DataFrame, chapters: DataFrame, keys: Sequence[str], floor: float = V.LINK_FLOOR) -> DataFrame:
    """Best chapter of the course for each row, with runner-up, method and review flag.

    `rows`: keys (user_id first), course_id, query, embedding (unit or null). A row meets its course's
    chapters as packed arrays and leaves each pack with its two best, so row-chapter pairs never
    become rows of their own.
    """
    keys = list(keys)
    facts = rows.select(
        *keys, "course_id", P.strip(F.col("query")).alias("query"), "embedding"
    ).withColumns({"words": X.title_tokens(F.col("query")), "stated": X.chapter_mentions(F.col("query"))})
    joined = facts.join(pack_chapters(chapters), ["user_id", "course_id"], "left")

    def score(c: Column) -> Column:
        title = X.set_similarity(F.col("words"), c["words"])
        cosine = F.when(F.col("embedding").isNotNull() & c["embedding"].isNotNull(), _dot(F.col("embedding"), c["embedding"]))
        meaning = F.greatest(title, V.LINK_EMBEDDING_WEIGHT * F.coalesce(cosine, F.lit(0.0)))
        bonus = F.when(F.array_contains("stated", c["chapter_num"].cast("int")), V.LINK_NUMBER_BONUS).otherwise(0.0)
        return F.struct(
            (-sql_round(meaning + bonus, 6)).alias("neg"), c["place"].alias("place"), c["source_id"].alias("source_id"),
            c["chapter_num"].alias("chapter_num"), c["title"].alias("title"), (bonus > 0).alias("agrees"),
        )

    scored = joined.withColumn("scored", F.array_sort(F.transform("pack", score)))
    scored = scored.select(
        *keys, "course_id", "query", F.slice("scored", 1, 2).alias("best"), F.exists("scored", lambda s: s["agrees"]).alias("any_number")
    )
    merged = scored.groupBy(*keys, "course_id", "query").agg(
        F.array_sort(F.flatten(F.collect_list("best"))).alias("best"), F.max("any_number").alias("any_number")
    )
    first, second = F.try_element_at("best", F.lit(1)), F.try_element_at("best", F.lit(2))
    out = merged.select(*keys, "course_id", "query", "any_number", first.alias("one"), second.alias("two"))
    top, runner = -F.col("one.neg"), -F.col("two.neg")
    ambiguous = F.coalesce((top - runner) < V.LINK_AMBIGUITY, F.lit(False))
    none, blank = F.col("one").isNull(), F.col("query") == ""
    method = F.concat(
        F.lit("semantic"), F.when(F.col("any_number"), "+number").otherwise(""), F.when(ambiguous & (top >= floor), "/ambiguous").otherwise("")
    )
    review = F.when(none, False).when(blank, True).otherwise((top < floor) | ambiguous)
    ref = F.concat_ws(":", "course_id", "one.source_id", F.col("one.chapter_num").cast("string"))
    return out.select(
        *keys,
        F.when(~review & ~none, ref).alias("chapter_ref"),
        F.when(none | blank, "").otherwise(F.col("one.title")).alias("chapter_title"),
        F.when(none | blank, 0.0).otherwise(top).alias("score"),
        F.when(none, "no-chapters").when(blank, "empty-row").otherwise(method).alias("method"),
        review.alias("needs_review"),
        F.when(~blank, runner).alias("runner_up"),
    )


def number_link(rows: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First stated chapter number that the course has; the comparison baseline."""
    keys = list(keys)
    per_number = chapters.groupBy("user_id", "course_id", "chapter_num").agg(F.max("source_id").alias("source_id"))
    stated = rows.select(*keys, "course_id", F.posexplode(X.chapter_mentions(F.col("query"))).alias("pos", "chapter_num"))
    hits = stated.withColumn("chapter_num", F.col("chapter_num").cast("long")).join(per_number, ["user_id", "course_id", "chapter_num"])
    ref = F.concat_ws(":", "course_id", "source_id", F.col("chapter_num").cast("string"))
    best = hits.groupBy(*keys).agg(F.min_by(ref, "pos").alias("chapter_ref"))
    return rows.select(*keys).join(best, keys, "left")


def link_compare(meaning: DataFrame, number: DataFrame) -> DataFrame:
    """Counts of two link outputs (row_id, link) and of their agreement."""
    both = meaning.withColumnRenamed("link", "m").join(number.withColumnRenamed("link", "n"), "row_id", "full_outer")
    return both.agg(
        F.count("*").alias("n_rows"), F.count("m").alias("meaning_linked"), F.count("n").alias("number_linked"),
        F.count_if(F.col("m") == F.col("n")).alias("agree"),
        F.count_if(F.col("m").isNotNull() & F.col("n").isNull()).alias("only_meaning"),
        F.count_if(F.col("m").isNull() & F.col("n").isNotNull()).alias("only_number"),
    )


def schedule_rows(extracted: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extraction rows as schedule rows with their links.

    `extracted`: keys, course_id, section, date, kind, title, covers array<string>, weight,
    confidence, embedding. A meeting links as one text; an assessment links each thing it covers.
    """
    keys = list(keys)
    whole = F.array(F.concat_ws(" ", "title", F.array_join("covers", " ")))
    items = F.when(F.col("section") == "meeting", whole).when(F.size("covers") > 0, F.col("covers")).otherwise(F.array("title"))
    parts = extracted.select(*keys, "course_id", "embedding", F.posexplode(items).alias("item_no", "query"))
    links = chapter_link(parts, chapters, [*keys, "item_no"])
    rows = F.array_sort(F.collect_list(F.when(F.col("chapter_ref").isNotNull(), F.struct("item_no", "chapter_ref", "chapter_title"))))
    merged = links.groupBy(*keys).agg(
        F.round(exact_avg(F.col("score")), 8).alias("link_score"),
        F.bool_or("needs_review").alias("flagged"),
        F.array_join(F.transform(rows, lambda r: r["chapter_ref"]), ",").alias("chapter_refs"),
        F.substring(F.array_join(F.transform(rows, lambda r: r["chapter_title"]), "; "), 1, 120).alias("link_title"),
    )
    is_exam = F.col("kind").isin(V.EXAM_KINDS)
    kind = F.when(F.col("section") == "meeting", "lecture").when(is_exam, "exam").otherwise("due")
    label = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    topic = F.when((F.col("title") == "") & (F.col("section") != "meeting"), label).otherwise(F.col("title"))
    out = extracted.select(*keys, "course_id", "date", kind.alias("kind"), topic.alias("topic"), "weight", "confidence")
    out = out.join(merged, keys)
    return out.withColumn("needs_review", F.col("flagged") | (F.col("confidence") == "low")).drop("flagged")


# --- commit and review ----------------------------------------------------------------------------------


def replace_extracted(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("user_id", "course_id")) -> DataFrame:
    """New rows in place of the extracted rows of the same courses; manual and edited rows stay."""
    committed = new.select(*keys).distinct().withColumn("origin", F.lit("extracted"))
    kept = existing.join(committed, [*keys, "origin"], "left_anti")
    return kept.unionByName(new)


def commit_summary(rows: DataFrame) -> DataFrame:
    linked = F.col("n_refs") > 0
    return rows.groupBy("user_id", "course_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("kind") == "lecture").alias("lectures"), F.count_if(F.col("kind") == "exam").alias("exams"),
        F.count_if(F.col("kind") == "due").alias("due_rows"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"),
        F.count_if("needs_review").alias("to_review"),
    )


def review_queue(schedule: DataFrame, chapters: DataFrame) -> DataFrame:
    """Flagged rows with the course's counts of flagged, total and choosable chapters."""
    key = ["user_id", "course_id"]
    counts = schedule.groupBy(*key).agg(F.count_if("needs_review").alias("flagged"), F.count("*").alias("total"))
    choices = chapters.select(*key, "source_id", "chapter_num").distinct().groupBy(*key).agg(F.count("*").alias("choices"))
    rows = schedule.where("needs_review").join(counts, key).join(choices, key, "left")
    return rows.withColumn("choices", F.coalesce("choices", F.lit(0)))


def review_apply(schedule: DataFrame, fixes: DataFrame) -> DataFrame:
    """Schedule rows after review fixes of the same tenant; a user's link has full confidence.

    `schedule`: user_id, id, topic, chapter_ref, link_score, link_method, needs_review. `fixes`:
    user_id, id, fix_no, fix_topic, fix_ref (null leaves the link), resolved. The last fix of a row wins.
    """
    last = first_row(fixes, ["user_id", "id"], [F.desc("fix_no")]).withColumn("fixed", F.lit(True))
    joined = schedule.join(last, ["user_id", "id"], "left")
    fixed, linked = F.coalesce("fixed", F.lit(False)), F.col("fix_ref").isNotNull()
    return joined.select(
        "user_id", "id",
        F.coalesce("fix_topic", "topic").alias("topic"),
        F.coalesce("fix_ref", "chapter_ref").alias("chapter_ref"),
        F.when(linked, 1.0).otherwise(F.col("link_score")).alias("link_score"),
        F.when(linked, "user").otherwise(F.col("link_method")).alias("link_method"),
        F.when(fixed, ~F.col("resolved")).otherwise(F.col("needs_review")).alias("needs_review"),
    )


# --- meetings ---------------------------------------------------------------------------------------------


def meeting_events(meetings: DataFrame, key_dates: DataFrame, terms: DataFrame) -> DataFrame:
    """Calendar events of weekly meetings and key dates.

    Term bounds left open are taken from the key dates; a meeting recurs only inside known bounds.
    `meetings`: user_id, course_id, days, start_time, end_time, location, label. `key_dates`: user_id,
    course_id, title, date (text), kind. `terms`: user_id, course_id, term_start, term_end.
    """
    key = ["user_id", "course_id"]
    stated = key_dates.where(F.trim("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumn("day", F.try_to_date(F.trim("date"), "yyyy-MM-dd"))
    stated = stated.where("day IS NOT NULL")
    found = stated.groupBy(*key).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    end = F.coalesce("term_end", "last_day")
    start = F.coalesce("term_start", F.least("first_day", F.date_sub(end, V.TERM_DEFAULT_DAYS)))
    start = F.when(F.col("first_day").isNull(), F.col("term_start")).otherwise(start)
    bounds = terms.join(found, key, "full_outer").select(*key, start.alias("date"), end.alias("recur_until"))
    bounded = bounds.where("date IS NOT NULL AND recur_until IS NOT NULL")
    label = F.substring(F.trim(F.coalesce("label", F.lit(""))), 1, 40)
    weekly = meetings.withColumn("recur_days", D.meeting_days(F.col("days"))).where("recur_days <> ''").join(bounded, key)
    weekly = weekly.select(
        *key, F.concat(F.lit("Class"), F.when(label != "", F.concat(F.lit(" · "), label)).otherwise("")).alias("title"),
        F.lit("class").alias("kind"), "date", F.lit("weekly").alias("recurrence"), "recur_days", "recur_until",
        D.clock_time(F.col("start_time")).alias("start_time"), D.clock_time(F.col("end_time")).alias("end_time"),
        F.substring(F.trim(F.coalesce("location", F.lit(""))), 1, 80).alias("location"),
    )
    kind = F.lower(F.trim(F.coalesce("kind", F.lit("deadline"))))
    single = stated.select(
        *key, F.substring(F.trim("title"), 1, 80).alias("title"),
        F.when(kind.isin("exam", "deadline", "project"), kind).otherwise("deadline").alias("kind"),
        F.col("day").alias("date"), F.lit("none").alias("recurrence"),
    )
    return weekly.unionByName(single, allowMissingColumns=True)


def syllabus_candidates(files: DataFrame) -> DataFrame:
    """Files of a course that may be its syllabus.

    `files`: user_id, course_id, code, course_title, source_id, file_name, explicit, text. A file counts
    by type, by name or by content, unless it names the code of another course; copies count once,
    explicit ones first.
    """
    clean = P.strip(F.col("text"))
    opening = F.substring(clean, 1, 12000)
    by_content = matches(opening, r"\bsyllabus\b") & matches(opening, V.SYLLABUS_STRUCTURE)
    named = matches(F.col("file_name"), V.SYLLABUS_NAME)
    usable = files.withColumn("clean", clean).where((F.col("clean") != "") & (F.col("explicit") | named | by_content))
    code = r"([A-Z]{2,8})\s*[- ]?(\d{1,4})"
    subject = F.regexp_extract(F.upper("code"), code, 1)
    number = F.regexp_extract(F.upper("code"), code, 2)
    calculus = F.contains(F.lower("course_title"), F.lit("calculus")) | subject.startswith("CALC")
    computing = F.contains(F.lower("course_title"), F.lit("computer science"))
    upper = F.upper(F.substring("clean", 1, 6000))
    subjects = F.regexp_extract_all(upper, F.lit(ascii_edges(V.SYLLABUS_CODE)), F.lit(1))
    numbers = F.regexp_extract_all(upper, F.lit(ascii_edges(V.SYLLABUS_CODE)), F.lit(2))
    found = usable.withColumns({"subject": subject, "number": number, "codes": F.arrays_zip(subjects.alias("s"), numbers.alias("n"))})
    maths = ["MATH", "MAT", "CALC"]

    def own(c: Column) -> Column:
        return (
            (c["s"] == F.col("subject")) | (computing & c["s"].isin("CS", "CSC", "CSCI")) | (calculus & c["s"].isin(maths))
        )

    def judge(own_codes: Column) -> Column:
        exact = F.exists(own_codes, lambda c: (c["s"] == F.col("subject")) & (c["n"] == F.col("number")))
        catalog = calculus & F.exists(own_codes, lambda c: c["s"].isin(maths))
        conflict = (F.size(own_codes) > 0) & ~catalog & ~exact
        academic = F.filter("codes", lambda c: c["s"].isin(V.ACADEMIC_PREFIXES))
        foreign = (
            (F.size(own_codes) == 0) & (F.length("number") >= 2) & (F.size(academic) > 0)
            & ~F.exists(academic, lambda c: c["n"] == F.col("number"))
        )
        return conflict | foreign

    other = let(F.filter("codes", own), judge)
    kept = found.where((F.col("subject") == "") | (F.col("number") == "") | ~other)
    kept = kept.withColumn("text_hash", F.sha2("clean", 256))
    best = first_row(kept, ["user_id", "course_id", "text_hash"], [F.desc("explicit"), F.asc("file_name"), F.asc("source_id")])
    order = Window.partitionBy("user_id", "course_id").orderBy(F.desc("explicit"), F.lower("file_name"), "source_id")
    return best.withColumn("choice", F.row_number().over(order)).select(
        "user_id", "course_id", "source_id", "file_name", "explicit", "text_hash", "choice"
    )
