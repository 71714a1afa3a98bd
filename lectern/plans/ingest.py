"""Ingest queries: files, marker and page text, outlines, page quality, audits, roll-ups."""

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.operators import ingest as I
from lectern.plans import sqltext as S
from lectern.plans.registry import query
from lectern.session import work_folder


def strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def ext(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {S.literal('(?i)' + pattern)}, {group})"


# --- files ----------------------------------------------------------------------------------


@query("corpus_scan")
def corpus_scan(t):
    """Files below the table folder that carry a corpus suffix, hashed; here the text tables written out."""
    target = work_folder(t.spark, "corpus-scan")
    texts = t("documents").select("text")
    texts.write.mode("overwrite").option("lineSep", "\n\n").option("compression", "none").text(target)
    return I.corpus_scan(t.spark, target).select("length", "file_hash")


@query("ingest_dedupe", """
    WITH f AS (SELECT page_id, user_id, course_id, sha256(content) AS file_hash FROM files_v),
    src AS (SELECT user_id, course_id, file_hash, 's' || page_id AS source_id, CASE WHEN page_id % 6 = 0 THEN 'failed' ELSE 'ok' END AS status FROM f WHERE page_id % 2 = 0),
    alive AS (SELECT * FROM src WHERE status = 'ok' AND source_id IN (SELECT 's' || page_id FROM f WHERE page_id % 5 <> 0))
    SELECT f.page_id, f.user_id, f.course_id, f.file_hash FROM f WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.user_id = f.user_id AND a.course_id = f.course_id AND a.file_hash = f.file_hash)""")
def ingest_dedupe(t):
    f = t("files_v").select("page_id", "user_id", "course_id", F.sha2("content", 256).alias("file_hash"))
    name = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    status = F.when(F.col("page_id") % 6 == 0, "failed").otherwise("ok")
    sources = f.where("page_id % 2 = 0").withColumns({"source_id": name, "status": status})
    chunks = f.where("page_id % 5 <> 0").withColumn("source_id", name)
    return I.ingest_dedupe(f, sources, chunks).select("page_id", "user_id", "course_id", "file_hash")


def _type_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{kind}'" for kind, words in V.SOURCE_TYPE_KEYWORDS)
    return f"CASE {cases} ELSE 'readings' END"


@query("source_type", f"SELECT page_id, {_type_sql('filename')} AS kind FROM files_v")
def source_type(t):
    return t("files_v").select("page_id", I.source_type(F.col("filename")).alias("kind"))


@query("source_ids", """
    WITH s AS (SELECT page_id, course_id, filename, substr(regexp_replace(regexp_replace(regexp_replace(lower(filename), '^(.+)\\.[^.]*$', '\\1'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 28) AS slug,
               substr(regexp_replace(lower(course_id), '[^a-z0-9]+', '', 'g'), 1, 16) AS c FROM files_v)
    SELECT page_id, CASE WHEN c = '' THEN 'course' ELSE c END AS course_slug, lower(course_id) || '_' || CASE WHEN slug = '' THEN substr(md5(filename), 1, 6) ELSE slug END AS source_id FROM s""")
def source_ids(t):
    return t("files_v").select(
        "page_id", I.slugify(F.col("course_id")).alias("course_slug"), I.source_id(F.col("course_id"), F.col("filename")).alias("source_id")
    )


HINTS = " ".join(f"WHEN contains(lower(error), {S.literal(n)}) THEN {S.literal(m)}" for n, m in V.FAILURE_HINTS)


@query("ingest_audit", f"""WITH r AS (SELECT *, CASE WHEN status <> 'ok' THEN CASE {HINTS} ELSE error_kind || ': ' || substr(regexp_replace(error, '[''"]?(?:/[^\\s''"]+)+[''"]?', 'the file', 'g'), 1, 160) END ELSE '' END AS detail FROM file_reports_v)
    SELECT user_id, course_id, status, detail, COUNT(*) AS n_files, CAST(SUM(chunks) AS BIGINT) AS total_chunks, CAST(SUM(pages) AS BIGINT) AS total_pages, MIN(filename) AS first_file FROM r GROUP BY ALL""")
def ingest_audit(t):
    return I.ingest_audit(t("file_reports_v"))


_LINE = """CASE item_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN '// note' ELSE '{"id": "q' || item_id || '", "q": "' || replace(replace(text, chr(10), ' '), '"', '') ||
    '", "in_corpus": ' || CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END || CASE WHEN item_id % 3 = 0 THEN ', "slice": "generated"' ELSE '' END ||
    ', "gold": [{"source": "src' || (item_id % 20) || '", "pages": [' || item_id || ', ' || (item_id + 2) || ']}]}' END AS value"""


@query("load_questions", f"""WITH l AS (SELECT {_LINE} FROM benchmark), j AS (SELECT value::JSON AS v FROM l WHERE trim(value) <> '' AND NOT starts_with(value, '//'))
    SELECT v->>'$.id' AS id, v->>'$.q' AS q, coalesce((v->>'$.in_corpus')::BOOLEAN, true) AS in_corpus, coalesce(v->>'$.slice', 'natural') AS slice, '' AS expect,
           v->>'$.gold[0].source' AS gold_source, (v->>'$.gold[0].pages[0]')::INTEGER AS page_lo, (v->>'$.gold[0].pages[1]')::INTEGER AS page_hi FROM j""")
def load_questions(t):
    lines = t.spark.sql("SELECT " + _LINE.replace("{", "{{").replace("}", "}}") + " FROM {benchmark}", benchmark=t("benchmark"))
    g = F.col("gold")[0]
    return I.load_questions(lines).select(
        "id", "q", "in_corpus", "slice", "expect", g["source"].alias("gold_source"), g["pages"][0].alias("page_lo"), g["pages"][1].alias("page_hi")
    )


@query("manifest_check", """
    SELECT user_id, course_id, upper(course_id) AS code, course_id <> 'es' AS expected, has_data_link AS derived, (course_id <> 'es') IS NOT DISTINCT FROM has_data_link AS agrees FROM courses_v""")
def manifest_check(t):
    c = t("courses_v")
    listed = F.struct("course_id", F.upper("course_id").alias("code"), (F.col("course_id") != "es").alias("expect_data_link"))
    lines = c.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(listed).alias("courses"))).alias("doc"))
    schema = "courses ARRAY<STRUCT<course_id: STRING, code: STRING, expect_data_link: BOOLEAN>>"
    manifest = lines.select("user_id", F.from_json("doc", schema).alias("m"))
    # the course id of several tenants' manifests is read together, so it carries its tenant
    scoped = manifest.select(F.transform("m.courses", lambda x: F.struct(
        F.concat("user_id", F.lit("/"), x["course_id"]).alias("course_id"), x["code"].alias("code"), x["expect_data_link"].alias("expect_data_link"))).alias("courses"))
    derived = c.select(F.concat("user_id", F.lit("/"), "course_id").alias("course_id"), "has_data_link")
    out = I.manifest_check(scoped, derived)
    return out.select(
        F.split_part("course_id", F.lit("/"), F.lit(1)).alias("user_id"), F.split_part("course_id", F.lit("/"), F.lit(2)).alias("course_id"),
        "code", "expected", "derived", "agrees",
    )


_JSON = """CASE event_id % 4 WHEN 0 THEN '["a' || event_id || '", "b"]' WHEN 1 THEN '[broken' WHEN 2 THEN NULL ELSE props END"""


@query("json_arrays", f"""WITH j AS (SELECT event_id, {_JSON} AS raw FROM events)
    SELECT event_id, coalesce(array_to_string(CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'ARRAY' THEN from_json(raw, '["VARCHAR"]') END END, '|'), '') AS items FROM j""")
def json_arrays(t):
    return t("events").select("event_id", F.array_join(I.json_array(F.expr(_JSON)), "|").alias("items"))


# --- marker text ------------------------------------------------------------------------------

_is = {n: f"regexp_matches(line, {S.literal('(?i)' + p)})" for n, p in (("c", V.MARKER_CHAPTER), ("s", V.MARKER_SECTION), ("p", V.MARKER_PAGE))}


@query("segment_markers", f"""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM marker_docs_v),
    k AS (SELECT *, CASE WHEN {_is['c']} THEN 'c' WHEN {_is['s']} THEN 's' WHEN {_is['p']} THEN 'p' ELSE 'b' END AS kind FROM l),
    e AS (SELECT *, SUM(CASE WHEN kind <> 'b' THEN 1 ELSE 0 END) OVER w AS seg,
        coalesce(last_value(CASE WHEN kind = 'c' THEN {ext('line', V.MARKER_CHAPTER, 1)}::INTEGER END IGNORE NULLS) OVER w, 0) AS chapter_num,
        coalesce(last_value(CASE WHEN kind = 'c' THEN {strip_sql(ext('line', V.MARKER_CHAPTER, 2))} END IGNORE NULLS) OVER w, '') AS chapter_title,
        coalesce(last_value(CASE WHEN kind = 'c' THEN '' WHEN kind = 's' THEN {strip_sql(ext('line', V.MARKER_SECTION, 1))} END IGNORE NULLS) OVER w, '') AS section,
        coalesce(last_value(CASE WHEN kind = 'p' THEN {ext('line', V.MARKER_PAGE, 1)}::INTEGER END IGNORE NULLS) OVER w, 1) AS page
      FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT doc_id, seg, chapter_num, chapter_title, section, page, {strip_sql("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM e WHERE kind = 'b' GROUP BY doc_id, seg, chapter_num, chapter_title, section, page)
    SELECT doc_id, CAST(seg AS BIGINT) AS seg, chapter_num, chapter_title, section, page, text FROM s WHERE text <> ''""")
def segment_markers(t):
    return I.segment_markers(t("marker_docs_v"), ["doc_id"])


# --- page text -----------------------------------------------------------------------------------

HEADER_SQL = (
    f"(regexp_matches({strip_sql('line')}, '^\\d{{1,{V.PAGE_NUMBER_MAX_DIGITS}}}$') OR (length({strip_sql('line')}) < {V.RUNNING_HEADER_MAX} "
    f"AND len(regexp_extract_all({strip_sql('line')}, '\\p{{L}}')) >= {V.RUNNING_HEADER_MIN_LETTERS} AND NOT regexp_matches({strip_sql('line')}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]')))"
)
PAGE_LINES = """pl AS (SELECT source_id, page, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM heading_pages_v)"""


@query("strip_headers", f"""WITH {PAGE_LINES} SELECT source_id, page, line_no, line FROM pl WHERE NOT (line_no < {V.RUNNING_HEADER_LINES} AND {HEADER_SQL})""")
def strip_headers(t):
    out = I.strip_headers(t("heading_pages_v"), ["source_id", "page"])
    return out.withColumn("line_no", F.col("line_no").cast("long"))


def roman_sql(x: str) -> str:
    table = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.ROMAN_VALUES.items())
    up = f"upper({strip_sql(x)})"
    vals = f"list_transform(string_split({up}, ''), lambda ch: CASE ch {table} ELSE 0 END)"
    total = f"list_sum(list_transform({vals}, lambda v, i: CASE WHEN v < coalesce(list_max(({vals})[i + 1:]), 0) THEN -v ELSE v END))"
    return f"CASE WHEN regexp_matches({up}, '^[{''.join(V.ROMAN_VALUES)}]+$') THEN CAST({total} AS INTEGER) END"


_ROMAN_TEXT = """CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE
    split_part(',X,XX,XXX,XL,L,LX,LXX,LXXX,XC', ',', CAST(floor(p_partkey % 100 / 10) AS INT) + 1) || split_part(',i,II,III,IV,V,VI,VII,VIII,IX', ',', CAST(p_partkey % 10 AS INT) + 1) END"""
PLAUSIBLE = "({x} = '' OR (length({x}) <= 60 AND regexp_matches({x}, '^[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}]')))"


@query("roman_numerals", f"""WITH r AS (SELECT p_partkey, {_ROMAN_TEXT} AS txt FROM part)
    SELECT p_partkey, txt, {roman_sql('txt')} AS value, {PLAUSIBLE.format(x="regexp_replace(coalesce(txt, ''), '^\\s+|\\s+$', '', 'g')")} AS plausible FROM r""")
def roman_numerals(t):
    r = t("part").select("p_partkey", F.expr(_ROMAN_TEXT).alias("txt"))
    return r.select("p_partkey", "txt", P.roman_to_int(F.col("txt")).alias("value"), P.plausible_heading(F.col("txt")).alias("plausible"))


_A = f"(length(line) < {V.HEADING_MAX_LINE} AND line <> '' AND regexp_matches(line, {S.literal('(?i)' + V.HEADING_CHAPTER)}))"
_R = f"(length(line) < {V.HEADING_MAX_LINE} AND line <> '' AND regexp_matches(line, {S.literal('(?i)' + V.HEADING_CHAPTER_ROMAN)}))"
_S = f"(length(line) < {V.HEADING_MAX_LINE} AND line <> '' AND regexp_matches(line, {S.literal('(?i)' + V.HEADING_SECTION)}))"
_a2 = strip_sql(ext("line", V.HEADING_CHAPTER, 2))
_r2 = strip_sql(ext("line", V.HEADING_CHAPTER_ROMAN, 2))


@query("segment_headings", f"""WITH {PAGE_LINES},
    kept AS (SELECT source_id, page, line_no, {strip_sql('line')} AS line FROM pl WHERE NOT (line_no < 2 AND {HEADER_SQL})
             AND (source_id, page) IN (SELECT source_id, page FROM heading_pages_v WHERE {strip_sql('text')} <> '')),
    k AS (SELECT *, CASE WHEN {_A} THEN CASE WHEN {PLAUSIBLE.format(x=_a2)} THEN 'a' ELSE 'b' END
                 WHEN {_R} THEN CASE WHEN {PLAUSIBLE.format(x=_r2)} THEN 'r' ELSE 'b' END WHEN {_S} THEN 's' ELSE 'b' END AS kind FROM kept),
    e AS (SELECT *, SUM(CASE WHEN kind <> 'b' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, page ORDER BY line_no) AS seg,
        coalesce(last_value(CASE WHEN kind = 'a' THEN {ext('line', V.HEADING_CHAPTER, 1)}::INTEGER WHEN kind = 'r' THEN {roman_sql(ext('line', V.HEADING_CHAPTER_ROMAN, 1))} END IGNORE NULLS) OVER w, 0) AS chapter_num,
        coalesce(last_value(CASE WHEN kind = 'a' THEN nullif({_a2}, '') WHEN kind = 'r' THEN coalesce(nullif({_r2}, ''), 'Chapter ' || upper({ext('line', V.HEADING_CHAPTER_ROMAN, 1)})) END IGNORE NULLS) OVER w, '') AS chapter_title,
        coalesce(last_value(CASE WHEN kind IN ('a', 'r') THEN '' WHEN kind = 's' THEN line END IGNORE NULLS) OVER w, '') AS section
      FROM k WINDOW w AS (PARTITION BY source_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT source_id, page, seg, chapter_num, chapter_title, section, {strip_sql("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM e WHERE kind = 'b' GROUP BY source_id, page, seg, chapter_num, chapter_title, section)
    SELECT source_id, page, CAST(seg AS BIGINT) AS seg, chapter_num, chapter_title, section, text FROM s WHERE text <> ''""")
def segment_headings(t):
    return I.segment_headings(t("heading_pages_v"), ["source_id"])


_raw = ext("title", V.OUTLINE_CHAPTER, 1)


@query("outline_asof", f"""WITH o AS (SELECT *, {S.has('title', V.OUTLINE_PAGE_LABEL)} AS is_label, {S.has('title', V.OUTLINE_CHAPTER)} AS is_ch,
        CASE WHEN regexp_matches({_raw}, '^\\d+$') THEN try_cast({_raw} AS INTEGER) ELSE {roman_sql(_raw)} END AS num, {strip_sql(ext('title', V.OUTLINE_CHAPTER, 2))} AS rest FROM outline_v WHERE page >= 1),
    ch AS (SELECT source_id, page, arg_max(num, entry_no) AS num, arg_max(CASE WHEN rest <> '' THEN rest ELSE {strip_sql('title')} END, entry_no) AS title FROM o WHERE NOT is_label AND is_ch AND coalesce(num, 0) <> 0 GROUP BY ALL),
    se AS (SELECT source_id, page, arg_max({strip_sql('title')}, entry_no) AS title FROM o WHERE NOT is_label AND NOT is_ch AND level >= 2 GROUP BY ALL),
    lb AS (SELECT source_id, page, arg_max({ext('title', V.OUTLINE_PAGE_LABEL, 1)}::INTEGER, entry_no) AS label FROM o WHERE is_label GROUP BY ALL),
    p AS (SELECT DISTINCT source_id, page FROM book_pages_v),
    a AS (SELECT p.source_id, p.page, ch.page AS ch_page, ch.num, ch.title AS ch_title FROM p ASOF LEFT JOIN ch ON ch.source_id = p.source_id AND ch.page <= p.page),
    b AS (SELECT a.*, se.page AS se_page, se.title AS se_title FROM a ASOF LEFT JOIN se ON se.source_id = a.source_id AND se.page <= a.page)
    SELECT b.source_id, b.page, coalesce(num, 0) AS chapter_num, coalesce(ch_title, '') AS chapter_title,
           CASE WHEN se_page >= coalesce(ch_page, 0) THEN se_title ELSE '' END AS section, CAST(coalesce(lb.label, b.page) AS BIGINT) AS printed_page
    FROM b LEFT JOIN lb ON lb.source_id = b.source_id AND lb.page = b.page""")
def outline_asof(t):
    return I.outline_asof(t("book_pages_v"), t("outline_v"), ["source_id"])


_STYLE = "CASE line_no % 9 WHEN 0 THEN 'Heading 1' WHEN 4 THEN 'heading 2' ELSE 'Normal' END"


@query("paginate_words", f"""WITH l AS (SELECT source AS source_id, doc_id, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    p AS (SELECT source_id, doc_id, line_no, {strip_sql('raw')} AS line, lower({_STYLE}) AS style FROM l WHERE {strip_sql('raw')} <> ''),
    k AS (SELECT *, {S.has('line', V.HEADING_CHAPTER)} AS named, contains(style, 'heading 1') OR {S.has('line', V.HEADING_CHAPTER)} AS ch FROM p),
    k2 AS (SELECT *, NOT ch AND (contains(style, 'heading 2') OR {S.has('line', V.HEADING_SECTION)}) AS se FROM k),
    e AS (SELECT *, SUM(CASE WHEN ch OR se THEN 1 ELSE 0 END) OVER w AS seg, SUM(CASE WHEN ch OR se THEN 0 ELSE len({S.words('line')}) END) OVER w AS so_far,
        last_value(CASE WHEN ch AND named THEN {ext('line', V.HEADING_CHAPTER, 1)}::INTEGER END IGNORE NULLS) OVER w AS chapter_num,
        last_value(CASE WHEN ch AND named THEN nullif({_a2}, '') WHEN ch THEN line END IGNORE NULLS) OVER w AS chapter_title,
        last_value(CASE WHEN ch THEN '' WHEN se THEN line END IGNORE NULLS) OVER w AS section
      FROM k2 WINDOW w AS (PARTITION BY source_id ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT source_id, CAST(seg AS BIGINT) AS seg, COUNT(*) AS n_paragraphs, CAST(MAX(so_far) // 500 + 1 AS BIGINT) AS page, coalesce(MAX(chapter_num), 0) AS chapter_num,
           coalesce(MAX(chapter_title), '') AS chapter_title, coalesce(MAX(section), '') AS section, CAST(SUM(len({S.words('line')})) AS BIGINT) AS n_words
    FROM e WHERE NOT ch AND NOT se GROUP BY source_id, seg""")
def paginate_words(t):
    lines = t("documents").select(F.col("source").alias("source_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    paragraphs = lines.withColumn("style", F.expr(_STYLE))
    out = I.paginate_words(paragraphs, ["source_id"], ["doc_id", "line_no"], F.floor(F.col("doc_id") / 64))
    return out.withColumn("page", F.col("page").cast("long"))


@query("page_quality", f"""WITH q AS (SELECT source_id, COUNT(*) AS n_pages, COUNT(*) FILTER (length({strip_sql('text')}) < {V.EMPTY_PAGE_CHARS}) AS n_ocr,
        COUNT(*) FILTER ({strip_sql('text')} = '') AS n_empty FROM heading_pages_v GROUP BY source_id)
    SELECT *, round(n_ocr / n_pages, 4) AS ocr_ratio, n_ocr / n_pages > {V.OCR_SLOW_RATIO} AS slow, n_empty / n_pages > {V.EMPTY_WARN_RATIO} AS mostly_empty FROM q""")
def page_quality(t):
    return I.page_quality(t("heading_pages_v"), "source_id")


# --- chapters, samples, capability ------------------------------------------------------------------


@query("chapter_rollup", """
    WITH c AS (SELECT *, row_number() OVER w AS place, coalesce(SUM(length(text)) OVER (PARTITION BY user_id, source_id, course_id, chapter_num ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
               FROM chunks_v WHERE chapter_num <> 0 WINDOW w AS (PARTITION BY user_id, source_id, course_id, chapter_num ORDER BY ordinal)),
    o AS (SELECT user_id, source_id, course_id, chapter_num, substr(string_agg(text, ' ' ORDER BY ordinal), 1, 900) AS opening FROM c WHERE before + greatest(place - 2, 0) < 900 GROUP BY ALL)
    SELECT c.user_id, c.source_id, c.course_id, c.chapter_num, arg_min(c.chapter_title, c.ordinal) AS title, MIN(c.page_start) AS page_start, MAX(c.page_end) AS page_end, ANY_VALUE(o.opening) AS opening,
           arg_min(c.chapter_title, c.ordinal) || '. ' || ANY_VALUE(o.opening) AS blob
    FROM c JOIN o USING (user_id, source_id, course_id, chapter_num) GROUP BY c.user_id, c.source_id, c.course_id, c.chapter_num""")
def chapter_rollup(t):
    return I.chapter_rollup(t("chunks_v"))


SAMPLE = """sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, course_id ORDER BY source_id, ordinal) - 1 AS sample_no FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, course_id, source_id ORDER BY ordinal) - 1 AS idx, COUNT(*) OVER (PARTITION BY user_id, course_id, source_id) AS n FROM chunks_v)
    WHERE idx % greatest(1, n // 20) = 0 AND idx / greatest(1, n // 20) < 20) WHERE sample_no < 40)"""


@query("systematic_sample", f"WITH {SAMPLE} SELECT user_id, course_id, source_id, chunk_id, sample_no FROM sampled")
def systematic_sample(t):
    out = I.systematic_sample(t("chunks_v"))
    return out.select("user_id", "course_id", "source_id", "chunk_id", F.col("sample_no").cast("long").alias("sample_no"))


def _count_sql(markers) -> str:
    return " + ".join(
        f"len(regexp_extract_all(lowered, {S.literal(m if ' ' in m else chr(92) + 'b' + m + chr(92) + 'b')}))" for m in markers
    )


_TAIL = "CASE course_id WHEN 'en' THEN ' inflation gdp unemployment monopoly interest rate wages wage' WHEN 'fr' THEN ' cache compiler novel inflation' ELSE '' END"


@query("capability_score", f"""WITH {SAMPLE},
    texts AS (SELECT s.user_id, s.course_id, string_agg(s.text || {_TAIL.replace('course_id', 's.course_id')}, chr(10) ORDER BY sample_no) AS joined FROM sampled s GROUP BY ALL),
    samples AS (SELECT user_id, course_id, {strip_sql("chr(10) || substr(joined, 1, 12000)")} AS sample FROM texts),
    c AS (SELECT user_id, course_id, length(sample) AS n_chars, lower(sample) AS lowered FROM samples),
    h AS (SELECT user_id, course_id, n_chars, {_count_sql(V.DATA_MARKERS)} AS data_hits, {_count_sql(V.NON_DATA_MARKERS)} AS other_hits FROM c)
    SELECT user_id, course_id, n_chars::INTEGER AS n_chars, data_hits::INTEGER AS data_hits, other_hits::INTEGER AS other_hits,
           CASE WHEN n_chars >= {V.CAPABILITY_MIN_CHARS} THEN round((data_hits + 1) / (other_hits + 1), 4) ELSE 0 END::DOUBLE AS score,
           n_chars >= {V.CAPABILITY_MIN_CHARS} AND (data_hits + 1) / (other_hits + 1) >= {V.CAPABILITY_RATIO} AS has_data_link FROM h""")
def capability_score(t):
    picked = I.systematic_sample(t("chunks_v")).select("user_id", "chunk_id", "course_id", "sample_no")
    texts = picked.join(t("chunks_v").select("user_id", "chunk_id", "text"), ["user_id", "chunk_id"])
    said = F.concat("text", F.expr(_TAIL))
    # at most 40 sampled chunks per course by construction of the sample
    joined = texts.groupBy("user_id", "course_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", said.alias("said")))).alias("rows"))
    sample = F.substring(F.array_join(F.transform("rows", lambda r: r["said"]), "\n"), 1, V.CAPABILITY_SAMPLE_CHARS)
    samples = joined.select("user_id", "course_id", P.strip(F.concat(F.lit("\n"), sample)).alias("sample"))
    return I.capability_score(samples, "user_id", "course_id")


@query("resolve_refs", """
    WITH r AS (SELECT id, user_id, course_id AS owner, CASE id % 5 WHEN 0 THEN course_id || ':*:' || (id % 30 + 1) WHEN 1 THEN course_id || ':s1:' || (id % 9 + 1) WHEN 2 THEN 'ch:14'
                      WHEN 3 THEN course_id || ':*:x' ELSE 'c9:*:4' END AS ref FROM schedule_v),
    src AS (SELECT user_id, course_id, COUNT(DISTINCT source_id) AS n, MIN(source_id) AS only_one, MIN(CASE WHEN user_id IN ('u1', 'u2', 'u3') AND source_id IN ('s1', 's2', 's4') THEN source_id END) AS prim FROM library_v GROUP BY ALL),
    p AS (SELECT *, string_split(ref, ':') AS a FROM r),
    q AS (SELECT id, user_id, ref, len(a) = 3 AND a[1] <> '' AND coalesce(try_cast(a[3] AS INTEGER), 0) > 0 AS good, a FROM p)
    SELECT q.id, q.user_id, q.ref, CASE WHEN NOT good THEN 'malformed' WHEN a[2] <> '*' OR prim IS NOT NULL OR n = 1 THEN 'resolved' WHEN coalesce(n, 0) = 0 THEN 'no_sources' ELSE 'ambiguous' END AS status,
      CASE WHEN good AND (a[2] <> '*' OR prim IS NOT NULL OR n = 1) THEN a[1] || ':' || coalesce(nullif(a[2], '*'), prim, only_one) || ':' || try_cast(a[3] AS INTEGER) END AS resolved
    FROM q LEFT JOIN src s ON s.user_id = q.user_id AND s.course_id = a[1] AND good""")
def resolve_refs(t):
    refs = t("schedule_v").selectExpr(
        "id", "user_id", "CASE id % 5 WHEN 0 THEN concat(course_id, ':*:', id % 30 + 1) WHEN 1 THEN concat(course_id, ':s1:', id % 9 + 1) "
        "WHEN 2 THEN 'ch:14' WHEN 3 THEN concat(course_id, ':*:x') ELSE 'c9:*:4' END AS ref",
    )
    primary = F.col("user_id").isin("u1", "u2", "u3") & F.col("source_id").isin("s1", "s2", "s4")
    sources = t("library_v").select("user_id", "course_id", "source_id", primary.alias("is_primary"))
    return I.resolve_refs(refs, sources)


@query("reembed_plan", """
    WITH c AS (SELECT 'u' || (user_id % 20) AS user_id, COUNT(*) AS n_chunks, MAX(ts) AS changed_at FROM events GROUP BY 1),
    s AS (SELECT user_id, MAX(ts) AS fitted_at FROM engagement_ev_v WHERE kind = 'export' GROUP BY user_id)
    SELECT c.user_id, n_chunks, fitted_at IS NULL OR fitted_at < changed_at AS refit, CASE WHEN fitted_at IS NULL OR fitted_at < changed_at THEN n_chunks ELSE 0 END AS n_reembed FROM c LEFT JOIN s USING (user_id)""")
def reembed_plan(t):
    chunks = t("events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"), F.col("event_id").alias("chunk_id"), F.col("ts").alias("added_at"))
    state = t("engagement_ev_v").where("kind = 'export'").groupBy("user_id").agg(F.max("ts").alias("fitted_at"))
    return I.reembed_plan(state, chunks).select("user_id", "n_chunks", "refit", "n_reembed")


@query("chapter_mentions", f"SELECT chunk_id, array_to_string({S.mentions(chr(39) + 'see Ch. ' + chr(39) + ' || (chunk_id % 120) || ' + chr(39) + ' and 14.1-14.3, chapter ' + chr(39) + ' || chapter_num || ' + chr(39) + ' ' + chr(39) + ' || text')}, ',') AS chapters FROM chunks_v")
def chapter_mentions(t):
    said = F.concat(F.lit("see Ch. "), (F.col("chunk_id") % 120).cast("string"), F.lit(" and 14.1-14.3, chapter "), F.col("chapter_num").cast("string"), F.lit(" "), "text")
    return t("chunks_v").select("chunk_id", F.array_join(F.transform(X.chapter_mentions(said), lambda n: n.cast("string")), ",").alias("chapters"))
