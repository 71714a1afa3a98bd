"""From files and page text to segments with their provenance, and the audit of an ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.functions.common import any_case, ascii_edges, matches, ratio, top_rows
from lectern.operators.scans import fill_forward, running_sum

# --- files -------------------------------------------------------------------------------


def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree with a corpus suffix: path, length, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = "|".join(V.CORPUS_SUFFIXES)
    kept = files.where(F.col("path").rlike(rf"(?i)\.({suffix})$"))
    return kept.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def load_questions(lines: DataFrame) -> DataFrame:
    """JSON lines (column `value`) to questions with defaults; blank and // lines are skipped."""
    schema = (
        "id STRING, q STRING, course STRING, in_corpus BOOLEAN, slice STRING, "
        "gold ARRAY<STRUCT<source: STRING, pages: ARRAY<INT>>>, gold_points ARRAY<STRING>, expect STRING, note STRING"
    )
    body = F.trim("value")
    kept = lines.where((body != "") & ~body.startswith("//"))
    parsed = kept.select(F.from_json(body, schema).alias("r")).select("r.*")
    empty_gold = F.array().cast("array<struct<source:string,pages:array<int>>>")
    return parsed.withColumns(
        {
            "in_corpus": F.coalesce("in_corpus", F.lit(True)),
            "slice": F.coalesce("slice", F.lit("natural")),
            "gold": F.coalesce("gold", empty_gold),
            "gold_points": F.coalesce("gold_points", F.array().cast("array<string>")),
            "expect": F.coalesce("expect", F.lit("")),
            "note": F.coalesce("note", F.lit("")),
        }
    )


def json_array(text: Column) -> Column:
    """A JSON list of strings; anything that does not parse is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def manifest_check(manifest: DataFrame, derived: DataFrame) -> DataFrame:
    """Courses listed in a manifest against what was derived: expected, derived, agrees."""
    listed = manifest.select(F.explode("courses").alias("c")).select("c.course_id", "c.code", F.col("c.expect_data_link").alias("expected"))
    joined = listed.join(derived.select("course_id", F.col("has_data_link").alias("derived")), "course_id", "left")
    return joined.withColumn("agrees", F.col("expected").eqNullSafe(F.col("derived")))


def ingest_dedupe(files: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that still need ingesting.

    A file is known when its tenant's course has a readable source of the same content that still
    has chunks.
    """
    key = ["user_id", "course_id", "file_hash"]
    alive = sources.where("status = 'ok'").join(chunks.select("user_id", "source_id"), ["user_id", "source_id"], "left_semi")
    return files.join(alive.select(*key), key, "left_anti")


def source_type(filename: Column) -> Column:
    lowered = F.lower(filename)
    out = None
    for kind, keywords in V.SOURCE_TYPE_KEYWORDS:
        found = lowered.rlike("|".join(keywords))
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise("readings")


def slugify(text: Column, fallback: str = "course") -> Column:
    slug = F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", ""), 1, 16)
    return F.when(slug == "", fallback).otherwise(slug)


def source_id(course: Column, filename: Column) -> Column:
    stem = F.regexp_replace(F.lower(filename), r"(?<=.)\.[^.]*$", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 28)
    fallback = F.substring(F.md5(filename.cast("binary")), 1, 6)
    return F.concat(F.lower(course), F.lit("_"), F.when(slug == "", fallback).otherwise(slug))


def failure_reason(kind: Column, message: Column) -> Column:
    """Plain words for a reader error; unknown errors keep their type and lose their paths."""
    lowered = F.lower(message)
    out = None
    for needle, reason in V.FAILURE_HINTS:
        found = F.contains(lowered, F.lit(needle))
        out = F.when(found, reason) if out is None else out.when(found, reason)
    cleaned = F.regexp_replace(message, "['\"]?(?:/[^\\s'\"]+)+['\"]?", "the file")
    return out.otherwise(F.concat(kind, F.lit(": "), F.substring(cleaned, 1, 160)))


def ingest_audit(reports: DataFrame) -> DataFrame:
    """Per course: files by status, chunk and page totals, and the failed files with reasons.

    `reports`: user_id, course_id, filename, status, error_kind, error, chunks, pages.
    """
    failed = F.col("status") != "ok"
    detail = F.when(failed, failure_reason(F.col("error_kind"), F.col("error"))).otherwise("")
    listed = reports.withColumn("detail", detail)
    return listed.groupBy("user_id", "course_id", "status", "detail").agg(
        F.count("*").alias("n_files"), F.sum("chunks").alias("total_chunks"), F.sum("pages").alias("total_pages"),
        F.min("filename").alias("first_file"),
    )


# --- marker text ---------------------------------------------------------------------------


def lines_of(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _segments(marked: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Join the body lines of each segment; segments without text disappear."""
    body = marked.where("is_body").groupBy(*keys, "seg", *carried).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows")
    )
    text = P.strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return body.withColumn("text", text).drop("rows").where("text <> ''")


def segment_markers(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments of texts whose comments state chapter, section and page from there on.

    The file is one row, so the windows below never hold more than one file.
    """
    line = F.col("line")
    chapter = matches(line, V.MARKER_CHAPTER)
    section = ~chapter & matches(line, V.MARKER_SECTION)
    page = ~chapter & ~section & matches(line, V.MARKER_PAGE)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(line, any_case(pattern), group)

    order = Window.partitionBy(*keys).orderBy("line_no")
    marker = chapter | section | page
    state = lines_of(docs, keys).withColumns(
        {
            "is_body": ~marker,
            "seg": F.sum(marker.cast("int")).over(order),
            "chapter_num": F.when(chapter, part(V.MARKER_CHAPTER, 1).cast("int")),
            "chapter_title": F.when(chapter, P.strip(part(V.MARKER_CHAPTER, 2))),
            "section": F.when(chapter, "").when(section, P.strip(part(V.MARKER_SECTION, 1))),
            "page": F.when(page, part(V.MARKER_PAGE, 1).cast("int")),
        }
    )
    start = {"chapter_num": 0, "chapter_title": "", "section": "", "page": 1}
    state = state.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.lit(v)) for c, v in start.items()})
    return _segments(state, keys, list(start))


# --- page text ---------------------------------------------------------------------------------


def strip_headers(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of each page without running headers among its first two lines."""
    lines = lines_of(pages, keys)
    return lines.where(~((F.col("line_no") < V.RUNNING_HEADER_LINES) & P.running_header(F.col("line"))))


def segment_headings(pages: DataFrame, source_keys: Sequence[str], page: str = "page", pages_per_block: int = 64) -> DataFrame:
    """Segments of page text whose headings state chapter and section from there on.

    Chapter and section carry over from page to page; the carrying is done per block of pages, so
    a source of any length stays parallel.
    """
    keys = [*source_keys, page]
    stripped = P.strip(F.col("line"))
    rows = strip_headers(pages.where(P.strip(F.col("text")) != ""), keys).withColumn("line", stripped)
    line = F.col("line")
    short = (F.length(line) < V.HEADING_MAX_LINE) & (line != "")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(line, any_case(pattern), group)

    arabic = short & matches(line, V.HEADING_CHAPTER)
    arabic_ok = arabic & P.plausible_heading(part(V.HEADING_CHAPTER, 2))
    roman_value = P.roman_to_int(part(V.HEADING_CHAPTER_ROMAN, 1))
    roman = short & ~arabic & matches(line, V.HEADING_CHAPTER_ROMAN)
    roman_ok = roman & P.plausible_heading(part(V.HEADING_CHAPTER_ROMAN, 2)) & roman_value.isNotNull()
    section = short & ~arabic & ~roman & matches(line, V.HEADING_SECTION)

    def non_empty(text: Column) -> Column:
        return F.when(P.strip(text) != "", P.strip(text))

    numeral = F.concat(F.lit("Chapter "), F.upper(part(V.HEADING_CHAPTER_ROMAN, 1)))
    rows = rows.withColumns(
        {
            "is_chapter": arabic_ok | roman_ok,
            "is_section": section,
            "chapter_num": F.when(arabic_ok, part(V.HEADING_CHAPTER, 1).cast("int")).when(roman_ok, roman_value),
            "chapter_title": F.when(arabic_ok, non_empty(part(V.HEADING_CHAPTER, 2))).when(
                roman_ok, F.coalesce(non_empty(part(V.HEADING_CHAPTER_ROMAN, 2)), numeral)
            ),
            "section": F.when(arabic_ok | roman_ok, "").when(section, line),
        }
    )
    heading = F.col("is_chapter") | F.col("is_section")
    rows = rows.withColumns(
        {
            "is_body": ~heading,
            "seg": F.sum(heading.cast("int")).over(Window.partitionBy(*keys).orderBy("line_no")),
        }
    )
    carried = ["chapter_num", "chapter_title", "section"]
    block = F.floor(F.col(page) / pages_per_block)
    rows = fill_forward(rows, source_keys, [page, "line_no"], block, carried)
    start = {"chapter_num": 0, "chapter_title": "", "section": ""}
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in start.items()})
    return _segments(rows, keys, carried)


def outline_asof(pages: DataFrame, outline: DataFrame, keys: Sequence[str], pages_per_block: int = 256) -> DataFrame:
    """Chapter, section and printed page in force on each page, from outline entries (level, title, page).

    A chapter entry ends the section before it; a page label counts for its own page only. Where
    several entries of a kind share a page the last one (entry_no) holds.
    """
    title = F.coalesce("title", F.lit(""))
    chapter_part = F.regexp_extract(title, any_case(V.OUTLINE_CHAPTER), 1)
    rest = P.strip(F.regexp_extract(title, any_case(V.OUTLINE_CHAPTER), 2))
    number = F.when(chapter_part.rlike(r"^\d+$"), F.col("raw").try_cast("int")).otherwise(P.roman_to_int(F.col("raw")))
    entries = outline.where("page >= 1").withColumn("raw", chapter_part)
    is_label = matches(title, V.OUTLINE_PAGE_LABEL)
    is_chapter = ~is_label & matches(title, V.OUTLINE_CHAPTER)
    is_section = ~is_label & ~is_chapter & (F.col("level") >= 2)
    entries = entries.select(
        *keys, "page", "entry_no",
        F.when(is_label, F.regexp_extract(title, any_case(V.OUTLINE_PAGE_LABEL), 1).cast("int")).alias("label"),
        F.when(is_chapter & (F.coalesce(number, F.lit(0)) != 0), F.struct("page", number.alias("num"), F.when(rest != "", rest).otherwise(P.strip(title)).alias("title"))).alias("chapter"),
        F.when(is_section, F.struct("page", P.strip(title).alias("title"))).alias("section"),
    )
    at_page = entries.groupBy(*keys, "page").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("entry_no"))).alias(c) for c in ("label", "chapter", "section")]
    )
    marks = at_page.withColumn("is_page", F.lit(False))
    asked = pages.select(*keys, "page").distinct().withColumn("is_page", F.lit(True))
    merged = marks.unionByName(asked, allowMissingColumns=True)
    filled = fill_forward(
        merged, keys, ["page", "is_page"], F.floor(F.col("page") / pages_per_block), ["chapter", "section"]
    ).where("is_page")
    labels = at_page.where("label IS NOT NULL").select(*keys, "page", F.col("label").alias("own_label"))
    joined = filled.drop("label").join(labels, [*keys, "page"], "left")
    in_force = F.col("section.page") >= F.coalesce("chapter.page", F.lit(0))
    return joined.select(
        *keys, "page",
        F.coalesce("chapter.num", F.lit(0)).alias("chapter_num"),
        F.coalesce("chapter.title", F.lit("")).alias("chapter_title"),
        F.when(in_force, F.col("section.title")).otherwise("").alias("section"),
        F.coalesce("own_label", "page").alias("printed_page"),
    )


def paginate_words(paragraphs: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Segments of a paragraph table with approximate pages of 500 words.

    Heading styles (or numbered headings) end a segment; its page is where its last word falls.
    """
    text = P.strip(F.col("text"))
    rows = paragraphs.where(text != "").withColumn("text", text).withColumn("style", F.lower(F.coalesce("style", F.lit(""))))
    line = F.col("text")
    named = matches(line, V.HEADING_CHAPTER)
    chapter = F.contains("style", F.lit("heading 1")) | named
    section = ~chapter & (F.contains("style", F.lit("heading 2")) | matches(line, V.HEADING_SECTION))
    rest = P.strip(F.regexp_extract(line, any_case(V.HEADING_CHAPTER), 2))
    rows = rows.withColumns(
        {
            "is_body": ~(chapter | section),
            "n_words": F.when(chapter | section, 0).otherwise(F.size(X.words(line))),
            "chapter_num": F.when(chapter & named, F.regexp_extract(line, any_case(V.HEADING_CHAPTER), 1).cast("int")),
            "chapter_title": F.when(chapter & named, F.when(rest != "", rest)).when(chapter, line),
            "section": F.when(chapter, "").when(section, line),
        }
    )
    heading = F.when(F.col("is_body"), 0).otherwise(1)
    rows = running_sum(rows, keys, order, block, heading, "seg")
    rows = running_sum(rows, keys, order, block, F.col("n_words"), "words_so_far")
    carried = ["chapter_num", "chapter_title", "section"]
    rows = fill_forward(rows, keys, order, block, carried)
    segments = rows.where("is_body").groupBy(*keys, "seg").agg(
        F.count("*").alias("n_paragraphs"),
        (F.floor(F.max("words_so_far") / V.WORDS_PER_PAGE) + 1).alias("page"),
        F.coalesce(F.max("chapter_num"), F.lit(0)).alias("chapter_num"),
        F.coalesce(F.max("chapter_title"), F.lit("")).alias("chapter_title"),
        F.coalesce(F.max("section"), F.lit("")).alias("section"),
        F.sum("n_words").alias("n_words"),
    )
    return segments


def page_quality(pages: DataFrame, *keys: str) -> DataFrame:
    """Share of image-only and of empty pages per document, with the two warnings."""
    text = F.col("text")
    out = pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"),
        F.count_if(P.needs_ocr(text)).alias("n_ocr"),
        F.count_if(P.strip(text) == "").alias("n_empty"),
    )
    ocr, empty = ratio(F.col("n_ocr"), F.col("n_pages")), ratio(F.col("n_empty"), F.col("n_pages"))
    return out.withColumns(
        {"ocr_ratio": F.round(ocr, 4), "slow": ocr > V.OCR_SLOW_RATIO, "mostly_empty": empty > V.EMPTY_WARN_RATIO}
    )


# --- chapters, samples, capability -----------------------------------------------------------------


def chapter_rollup(chunks: DataFrame) -> DataFrame:
    """Per source and chapter: first title, page range and the opening text.

    Chunks are added while the opening is shorter than 900 characters. Every chunk adds at least its
    separator, so no more than 901 of them can matter and Spark keeps only those.
    """
    key = ["user_id", "source_id", "course_id", "chapter_num"]
    numbered = chunks.where(F.col("chapter_num") != 0)
    facts = numbered.groupBy(*key).agg(
        F.min_by("chapter_title", "ordinal").alias("title"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")
    )
    limit = V.CHAPTER_OPENING_CHARS
    openers = top_rows(numbered.select(*key, "ordinal", "text"), key, [F.asc("ordinal")], limit + 1, "place")
    before = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) + F.greatest(F.col("place") - 1, F.lit(0))
    openers = openers.withColumn("so_far", so_far).where(F.col("so_far") < limit)
    text = openers.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("rows"))
    opening = F.substring(F.array_join(F.transform("rows", lambda r: r["text"]), " "), 1, limit)
    out = facts.join(text.select(*key, opening.alias("opening")), key)
    return out.withColumn("blob", F.concat("title", F.lit(". "), "opening"))


def systematic_sample(chunks: DataFrame, rows_per_block: int = 4096) -> DataFrame:
    """An even sample of each file's chunks, at most 20 per file and 40 per course."""
    key = ["user_id", "course_id", "source_id"]
    rows = chunks.select(*key, "chunk_id", "ordinal")
    placed = running_sum(rows, key, ["ordinal"], F.floor(F.col("ordinal") / rows_per_block), F.lit(1), "place")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / V.SAMPLE_PER_FILE))
    index = F.col("place") - 1
    picked = placed.join(sizes, key).where((index % step == 0) & (index / step < V.SAMPLE_PER_FILE)).drop("n")
    return top_rows(picked, ["user_id", "course_id"], [F.asc("source_id"), F.asc("ordinal")], V.SAMPLE_PER_BATCH, "sample_no")


def _marker_count(text: Column, markers: Sequence[str]) -> Column:
    total = F.lit(0)
    for marker in markers:
        pattern = marker if " " in marker else ascii_edges(rf"\b{marker}\b")
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def capability_score(samples: DataFrame, *keys: str) -> DataFrame:
    """Whether a course studies what published series measure, from its sampled text.

    `samples`: keys, sample (the joined text). Marker words count at word boundaries, marker phrases
    anywhere.
    """
    lowered = F.lower("sample")
    counted = samples.select(
        *keys,
        _marker_count(lowered, V.DATA_MARKERS).alias("data_hits"),
        _marker_count(lowered, V.NON_DATA_MARKERS).alias("other_hits"),
        F.length("sample").alias("n_chars"),
    )
    enough = F.col("n_chars") >= V.CAPABILITY_MIN_CHARS
    score = (F.col("data_hits") + 1) / (F.col("other_hits") + 1)
    return counted.withColumn("score", F.when(enough, F.round(score, 4)).otherwise(0.0)).withColumn(
        "has_data_link", enough & (score >= V.CAPABILITY_RATIO)
    )


# --- references --------------------------------------------------------------------------------------


def parse_ref(ref: Column) -> Column:
    """'course:source:chapter' as a struct with a null source for '*'; null when malformed."""
    parts = F.split(F.trim(ref), ":")
    chapter = F.try_element_at(parts, F.lit(3))
    number = F.when(chapter.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(chapter).cast("int"))
    valid = (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) != "") & (number > 0)
    source = F.try_element_at(parts, F.lit(2))
    return F.when(
        valid,
        F.struct(
            F.try_element_at(parts, F.lit(1)).alias("course_id"),
            F.when(source != "*", source).alias("source_id"),
            number.alias("chapter"),
        ),
    )


def resolve_refs(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Bind partial references to a source: status resolved, ambiguous, no_sources or malformed.

    `refs`: user_id, ref (+ columns). `sources`: user_id, course_id, source_id, is_primary. Candidates
    are counted per course before the join, so a course with many sources adds no rows.
    """
    per_course = sources.groupBy("user_id", "course_id").agg(
        F.count_distinct("source_id").alias("n_sources"),
        F.min("source_id").alias("only_source"),
        F.min(F.when(F.col("is_primary"), F.col("source_id"))).alias("primary_source"),
    )
    parsed = refs.withColumn("r", parse_ref(F.col("ref")))
    parsed = parsed.select(*refs.columns, F.col("r").isNull().alias("bad"), "r.course_id", "r.source_id", "r.chapter")
    joined = parsed.join(per_course, ["user_id", "course_id"], "left")
    n = F.coalesce("n_sources", F.lit(0))
    bound = F.coalesce("source_id", "primary_source", F.when(n == 1, F.col("only_source")))
    status = (
        F.when(F.col("bad"), "malformed").when(bound.isNotNull(), "resolved").when(n == 0, "no_sources").otherwise("ambiguous")
    )
    canonical = F.when(status == "resolved", F.concat_ws(":", "course_id", bound, F.col("chapter").cast("string")))
    return joined.select(*refs.columns, status.alias("status"), canonical.alias("resolved"))


def reembed_plan(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tenants whose stateful encoder is older than their corpus, with the rows to embed again.

    `state`: user_id, fitted_at. `chunks`: user_id, chunk_id, added_at.
    """
    per_user = chunks.groupBy("user_id").agg(F.count("*").alias("n_chunks"), F.max("added_at").alias("changed_at"))
    joined = per_user.join(state, "user_id", "left")
    stale = F.col("fitted_at").isNull() | (F.col("fitted_at") < F.col("changed_at"))
    return joined.withColumn("refit", stale).withColumn("n_reembed", F.when(stale, F.col("n_chunks")).otherwise(0))


