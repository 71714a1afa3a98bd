"""Text queries: token estimates, blocks, chunks, labels, features, extractive answers."""

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.operators import answers as A
from lectern.operators import chunking as C
from lectern.operators import features as FE
from lectern.plans import retrieval as PR
from lectern.plans import sqltext as S
from lectern.plans.ingest import strip_sql
from lectern.plans.registry import query

KEY = ["user_id", "q_id"]


def estimate_sql(x: str) -> str:
    return f"CAST(floor(len({S.words(x)}) * {V.TOKENS_PER_WORD}) + 1 AS INTEGER)"


def display_sql(s: str) -> str:
    w = S.words(s)
    wordy = f"len(list_filter({w}, lambda x: length(x) > 3 AND regexp_matches(x, '^\\p{{L}}+$')))"
    return (
        f"(length({s}) > 0 AND length({s}) < 120 AND regexp_matches({s}, {S.literal(V.EQUATION_RELATION)}) "
        f"AND len({w}) <= 14 AND {wordy} <= greatest(2, len({w}) // 3))"
    )


def continues_sql(s: str) -> str:
    return (
        f"({display_sql(s)} OR (length({s}) <= {V.EQUATION_CONTINUATION_MAX} AND regexp_matches({s}, {S.literal(V.EQUATION_CONTINUATION)}) "
        f"AND regexp_matches({s}, '[A-Za-z0-9}}]')))"
    )


def kind_sql(s: str) -> str:
    lines = f"list_filter(string_split({s}, chr(10)), lambda x: trim(x) <> '')"
    tabular = f"len(list_filter({lines}, lambda x: regexp_matches(x, {S.literal(V.BLOCK_TABLE_LINE)})))"
    ops = f"(length({s}) - length(translate({s}, '{V.EQUATION_OPERATORS}', '')))"
    return (
        f"CASE WHEN {s} = '' THEN 'prose' WHEN regexp_matches({s}, {S.literal('(?i)' + V.BLOCK_DEFINITION)}) THEN 'definition' "
        f"WHEN len({lines}) > 0 AND {tabular} >= greatest(2.0, len({lines}) * 0.6) THEN 'table' "
        f"WHEN len({lines}) <= 3 AND regexp_matches({s}, {S.literal(V.BLOCK_EQUATION_HINT)}) AND length({s}) < 400 "
        f"AND (regexp_matches({s}, {S.literal('(?s)' + V.BLOCK_EQUATION)}) OR {ops} >= 2) THEN 'equation' ELSE 'prose' END"
    )


@query("token_estimate", f"SELECT doc_id, {estimate_sql('text')} AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


MATH_LINES = f"""ml AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM math_pages_v),
sl AS (SELECT doc_id, line_no, {strip_sql('raw')} AS s FROM ml)"""


@query("display_equation", f"WITH {MATH_LINES} SELECT doc_id, line_no, {display_sql('s')} AS is_equation FROM sl")
def display_equation(t):
    lines = t("math_pages_v").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), P.display_equation(F.col("line")).alias("is_equation"))


@query("block_kind", f"""WITH p AS (SELECT doc_id, UNNEST(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS para FROM math_pages_v),
    s AS (SELECT doc_id, para, {strip_sql('raw')} AS s FROM p) SELECT doc_id, para, {kind_sql('s')} AS kind FROM s""")
def block_kind(t):
    paras = t("math_pages_v").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("para", "body"))
    return paras.select("doc_id", F.col("para").cast("long").alias("para"), P.block_kind(F.col("body")).alias("kind"))


@query("page_blocks", f"""WITH p0 AS (SELECT doc_id, UNNEST(string_split_regex(text, '\\n\\s*\\n')) AS raw, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) - 1 AS para FROM math_pages_v),
    p AS (SELECT doc_id, para, string_split({strip_sql('raw')}, chr(10)) AS parts FROM p0 WHERE {strip_sql('raw')} <> ''),
    l AS (SELECT doc_id, para, len(parts) AS n, UNNEST(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM p),
    f AS (SELECT *, n > 1 AND {display_sql('st')} AS starts, n > 1 AND regexp_matches(st, {S.literal(V.EQUATION_NUMBER)}) AS num, n > 1 AND NOT regexp_matches(st, {S.literal(V.EQUATION_NUMBER)}) AND {continues_sql('st')} AS follows
          FROM (SELECT *, {strip_sql('line')} AS st FROM l)),
    r AS (SELECT *, SUM(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para ORDER BY line_no) AS run FROM f),
    i AS (SELECT *, follows AND coalesce(bool_or(starts) OVER (PARTITION BY doc_id, para, run ORDER BY line_no), false) AS ins FROM r),
    n1 AS (SELECT *, num AND coalesce(lag(ins) OVER (PARTITION BY doc_id, para ORDER BY line_no), false) AS takes FROM i),
    n2 AS (SELECT *, ins OR takes AS eq, lag(ins OR takes) OVER w AS was, coalesce(lag(takes) OVER w, false) AS closed FROM n1 WINDOW w AS (PARTITION BY doc_id, para ORDER BY line_no)),
    b AS (SELECT *, SUM(CASE WHEN was IS NULL OR was <> eq OR (closed AND eq) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY line_no) - 1 AS block FROM n2),
    g AS (SELECT doc_id, para, block, eq, CASE WHEN eq THEN string_agg(st, ' ' ORDER BY line_no) ELSE {strip_sql("string_agg(line, chr(10) ORDER BY line_no)")} END AS body FROM b GROUP BY doc_id, para, block, eq)
    SELECT doc_id, para, CAST(block AS BIGINT) AS block, body, CASE WHEN eq THEN 'equation' ELSE {kind_sql('body')} END AS kind FROM g WHERE body <> ''""")
def page_blocks(t):
    out = C.page_blocks(t("math_pages_v"), ["doc_id"])
    return out.select("doc_id", F.col("para").cast("long").alias("para"), F.col("block").cast("long").alias("block"), "body", "kind")


def grouped_blocks(t):
    """Blocks of each document as one file: a chapter every five paragraphs, parents may run over pages."""
    pages = t("math_pages_v").select("doc_id", "page", "text")
    blocks = C.segment_blocks(pages, ["doc_id"], "page")
    blocks = blocks.withColumn("chapter_num", F.floor(F.col("para") / 5) + 1)
    return C.parent_groups(blocks, ["doc_id"])


@query("math_normalise")
def math_normalise(t):
    return t("math_pages_v").select("doc_id", P.canonical_math(F.col("text")).alias("text"))


@query("prose_split")
def prose_split(t):
    pieces = C.split_prose(F.col("text"), V.CHILD_TOKENS, V.CHILD_OVERLAP)
    return t("documents").select("doc_id", F.posexplode(pieces).alias("piece", "text"))


@query("parent_groups")
def parent_groups(t):
    return grouped_blocks(t).select("doc_id", "block_no", "chapter_num", "kind", "tokens", "parent_no")


@query("child_chunks")
def child_chunks(t):
    grouped = grouped_blocks(t)
    ids = X.chunk_key(F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("ordinal"))
    out = C.child_chunks(grouped, ["doc_id"])
    return out.withColumn("chunk_id", ids)


@query("embed_text", f"SELECT chunk_id, md5({S.embed_text()}) AS hash, length({S.embed_text()})::INTEGER AS n FROM chunks_v")
def embed_text(t):
    body = X.embed_text(F.col("course_id"), F.col("chapter_num"), F.col("chapter_title"), F.col("section"), F.col("text"))
    return t("chunks_v").select("chunk_id", F.md5(body.cast("binary")).alias("hash"), F.length(body).alias("n"))


@query("chunk_ids", """SELECT chunk_id, 'u' || substr(sha1(user_id), 1, 8) || '_' || source_id || '_' || printf('%04d', ordinal) AS chunk_key,
    'u' || substr(sha1(user_id), 1, 8) || '_' || source_id || '_p' || printf('%04d', chapter_num) AS parent_key FROM chunks_v""")
def chunk_ids(t):
    c = F.col
    return t("chunks_v").select(
        "chunk_id", X.chunk_key(c("user_id"), c("source_id"), c("ordinal")).alias("chunk_key"), X.parent_key(c("user_id"), c("source_id"), c("chapter_num")).alias("parent_key")
    )


LABEL = """'[' || course_id || CASE WHEN chapter_num <> 0 THEN ', Ch ' || chapter_num ELSE '' END || ', ' ||
    CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END || ']'"""


def label(c=F.col):
    return X.citation_label(c("course_id"), c("chapter_num"), c("page_start"), c("page_end"))


@query("citation_label", f"SELECT chunk_id, {LABEL} AS label FROM chunks_v")
def citation_label(t):
    return t("chunks_v").select("chunk_id", label().alias("label"))


_COMBINED = "text || ' [' || lang || ', Ch ' || (doc_id % 20) || ', p. ' || (doc_id % 90) || '; ' || lang || ', pp. 3-4] [see note] [' || lang || ', p. 7]'"


@query("citation_split", f"""SELECT doc_id, regexp_replace(text, '\\s+$', '') = text AS tidy, text || ' [' || lang || ', Ch ' || (doc_id % 20) || ', p. ' || (doc_id % 90) || '] [' || lang || ', pp. 3-4] [see note] [' || lang || ', p. 7]' AS fixed FROM documents
    WHERE NOT regexp_matches(text, '\\[')
    UNION ALL SELECT doc_id, regexp_replace(text, '\\s+$', '') = text, text FROM documents WHERE regexp_matches(text, '\\[')""")
def citation_split(t):
    """Answers that end in a combined bracket; texts with brackets of their own stay as they are."""
    d = t("documents")
    own = F.contains("text", F.lit("["))
    said = F.when(own, F.col("text")).otherwise(F.expr(_COMBINED))
    tidy = F.regexp_replace("text", r"\s+$", "") == F.col("text")
    return d.select("doc_id", tidy.alias("tidy"), A.citation_split(said).alias("fixed"))


_RANGE_TEXT = "'Read ' || CASE WHEN chunk_id % 3 = 0 THEN chapter_num || '.1-' || chapter_num || '.' || (chunk_id % 9) WHEN chunk_id % 3 = 1 THEN chapter_num || '.2 – 7' ELSE 'all' END || ' ' || text"


@query("section_range", f"""WITH r AS (SELECT chunk_id, {_RANGE_TEXT} AS txt FROM chunks_v) SELECT chunk_id, {", ".join(
    f"try_cast(nullif(regexp_extract(txt, {S.literal(V.SECTION_RANGE)}, {i}), '') AS INTEGER) AS {n}" for i, n in enumerate(("chapter", "first_section", "last_section"), 1))} FROM r""")
def section_range(t):
    r = t("chunks_v").select("chunk_id", F.expr(_RANGE_TEXT).alias("txt"))
    r = r.select("chunk_id", X.section_range(F.col("txt")).alias("r"))
    return r.select("chunk_id", "r.chapter", "r.first_section", "r.last_section")


# --- features ---------------------------------------------------------------------------------

@query("tfidf_weights", f"""WITH {S.grams('chunk', 'chunks_v', 'user_id, chunk_id')}, {S.vocabulary()}, {S.gram_weights('chunk', 'user_id, chunk_id')}
    SELECT user_id, chunk_id, kind, COUNT(*) AS n_terms,
           md5(string_agg(term || ':' || round(weight * 1000000)::BIGINT, ',' ORDER BY term)) AS weights_hash FROM chunk_w GROUP BY ALL""")
def tfidf_weights(t):
    """The weight vectors of all chunks; every term and weight, to six digits, goes into the hash."""
    w = FE.tfidf_weights(t("chunks_v"))
    millionths = lambda x: x["weight"] * 1000000
    nearest = lambda v: F.floor(v) + F.when(v - F.floor(v) >= 0.5, 1).otherwise(0)
    each = F.transform(F.sort_array("terms"), lambda x: F.concat(x["term"], F.lit(":"), nearest(millionths(x)).cast("string")))
    return w.select(
        "user_id", "chunk_id", "kind", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join(each, ",").cast("binary")).alias("weights_hash")
    )


@query("lsa_embed")
def lsa_embed(t):
    return FE.lsa_embed(t("chunks_v"))


# --- answers -------------------------------------------------------------------------------------


def passages(t):
    """The top passages of each question with their citation labels."""
    hits = PR.sparse_lists(t).where(f"rank < {V.FINAL_TOP_K}")
    return hits.join(t("chunks_v").withColumn("label", label()), ["user_id", "chunk_id"])


PASSAGES = f"{PR.SPARSE}, passages AS (SELECT s.user_id, s.q_id, s.chunk_id, s.rank, c.text, c.course_id, c.source_id, c.chapter_num, {LABEL} AS label FROM sparse s JOIN chunks_v c USING (user_id, chunk_id) WHERE s.rank < 6)"
_AT = S.term_set("sentence", V.ANSWER_STOPWORDS, V.ANSWER_MIN_TERM)
ANSWER = f"""{PASSAGES},
asked AS (SELECT user_id, q_id, {S.term_set('q', V.ANSWER_STOPWORDS, V.ANSWER_MIN_TERM)} AS qt FROM questions_v),
said AS (SELECT user_id, q_id, rank, label, UNNEST(ss) AS raw, generate_subscripts(ss, 1) AS pos FROM (SELECT *, {S.sentences('text')} AS ss FROM passages)),
sent AS (SELECT user_id, q_id, rank, pos, label, {strip_sql('raw')} AS sentence FROM said),
pool0 AS (SELECT s.*, list_intersect({_AT}, qt) AS ov, trim(split_part(substr(label, 2), ',', 1)) AS course FROM sent s JOIN asked USING (user_id, q_id) WHERE length(sentence) > 20 AND length(sentence) < 400),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q_id, course, sentence ORDER BY rank, pos) AS rn FROM pool0 WHERE len(ov) > 0) WHERE rn = 1),
st0 AS (SELECT DISTINCT user_id, q_id, []::VARCHAR[] AS cov, []::VARCHAR[] AS taken, NULL::VARCHAR AS locked FROM pool)""" + "".join(f""",
pk{i} AS (SELECT * FROM (SELECT p.user_id, p.q_id, p.rank, p.label, p.sentence, p.ov, p.course, s.cov, s.taken, s.locked,
    row_number() OVER (PARTITION BY p.user_id, p.q_id ORDER BY round((len(list_filter(p.ov, lambda z: NOT list_contains(s.cov, z))) + {V.ANSWER_OVERLAP_WEIGHT} * len(p.ov)) * (1.0::DOUBLE / (1.0 + {V.ANSWER_RANK_DECAY} * p.rank)), 9) DESC, p.rank, p.pos) AS r
    FROM pool p JOIN st{i} s USING (user_id, q_id) WHERE (s.locked IS NULL OR s.locked = p.course) AND NOT list_contains(s.taken, p.sentence)) WHERE r = 1),
st{i + 1} AS (SELECT user_id, q_id, list_distinct(list_concat(cov, ov)) AS cov, list_append(taken, sentence) AS taken, coalesce(locked, course) AS locked FROM pk{i})""" for i in range(4)) + """,
picks AS (""" + " UNION ALL ".join(f"SELECT user_id, q_id, {i} AS step, rank, label, sentence FROM pk{i}" for i in range(4)) + ")"


def answer_picks(t, found=None):
    return A.extractive_answer(found if found is not None else passages(t), t("questions_v"), KEY)


@query("extractive_answer", f"WITH {ANSWER} SELECT user_id, q_id, string_agg(sentence || ' ' || label, ' ' ORDER BY step) AS answer FROM picks GROUP BY ALL")
def extractive_answer(t):
    return A.answer_text(answer_picks(t), KEY).select(*KEY, "answer")


@query("citation_dedupe", f"""WITH {ANSWER} SELECT user_id, q_id, chunk_id, MIN(rank) AS rank FROM passages p
    WHERE EXISTS (SELECT 1 FROM picks k WHERE k.user_id = p.user_id AND k.q_id = p.q_id AND k.label = p.label) GROUP BY ALL""")
def citation_dedupe(t):
    found = passages(t)
    out = A.citation_dedupe(found, answer_picks(t, found), KEY)
    return out.select(*KEY, "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("engagement_credit", f"""WITH {PASSAGES} SELECT user_id, chapter_ref, COUNT(*) AS questions FROM
    (SELECT DISTINCT user_id, q_id, course_id || ':' || source_id || ':' || chapter_num AS chapter_ref FROM passages) GROUP BY ALL""")
def engagement_credit(t):
    cited = passages(t).withColumn("chapter_ref", F.concat_ws(":", "course_id", "source_id", F.col("chapter_num").cast("string")))
    return A.engagement_credit(cited, ["q_id"])
