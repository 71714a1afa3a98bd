"""Retrieval queries over the documents (chunks), the benchmark items (questions) and embeddings."""

from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as X
from lectern.functions.common import exact_sum, sql_round
from lectern.operators import retrieval as R
from lectern.plans import sqltext as S
from lectern.plans.registry import query
from lectern.sources.gold import containing_chunks

KEY = ["user_id", "q_id"]


def index_of(t, stored=True):
    return R.build_index(t("chunks_v"), stored)


def sparse_lists(t, index=None):
    return R.bm25_topk(t("questions_v"), index or index_of(t), KEY)


def dense_lists(t):
    return R.dense_topk(t("query_vectors_v"), t("chunk_vectors_v"))


def both_lists(t, index=None):
    """Sparse (list 0) and dense (list 1) ranks of every question with weight 1."""
    lists = [sparse_lists(t, index), dense_lists(t)]
    out = [d.select(*KEY, "chunk_id", "rank", F.lit(n).alias("list_no"), F.lit(1.0).alias("weight")) for n, d in enumerate(lists)]
    return out[0].unionByName(out[1])


def fused_lists(t, index=None):
    return R.rrf(both_lists(t, index), KEY)


def gold_of(t):
    return containing_chunks(t("questions_v"), t("chunks_v"))


# --- SQL pieces -----------------------------------------------------------------------

FRAMING = S.quoted(V.FRAMING_WORDS)


def rerank_sql(candidates: str, questions: str = "questions_v", text: str = "q", name: str = "reranked") -> str:
    """CTE `name` (user_id, q_id, chunk_id, n_matched, win, rerank_score) for the candidate pairs."""
    return f"""
{name}_toks AS (SELECT user_id, q_id, {S.tokens(text)} AS toks FROM {questions}),
{name}_flat AS (SELECT user_id, q_id, UNNEST(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_toks),
{name}_uniq AS (SELECT user_id, q_id, token, MIN(pos) AS pos FROM {name}_flat GROUP BY ALL),
{name}_any AS (SELECT user_id, q_id, COUNT(*) FILTER (token NOT IN ({FRAMING})) AS n_content FROM {name}_uniq GROUP BY ALL),
{name}_idf AS (SELECT u.user_id, u.q_id, u.token, u.pos,
      round(ln((c.n_docs + 1) / (coalesce(d.df, 0) + 0.5)), 10) AS idf
    FROM {name}_uniq u JOIN {name}_any a USING (user_id, q_id) JOIN corpus c USING (user_id)
    LEFT JOIN dfs d ON d.user_id = u.user_id AND d.token = u.token
    WHERE a.n_content = 0 OR u.token NOT IN ({FRAMING})),
{name}_terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q_id ORDER BY idf DESC, pos) AS term_no
    FROM {name}_idf) WHERE term_no <= {V.RERANK_MAX_TERMS}),
{name}_total AS (SELECT user_id, q_id, SUM(idf) AS total FROM {name}_terms GROUP BY ALL),
{name}_cand AS (SELECT DISTINCT c.user_id, c.q_id, c.chunk_id, t.toks FROM {candidates} c JOIN tok t USING (user_id, chunk_id)),
{name}_pos AS (SELECT f.user_id, f.q_id, f.chunk_id, f.token, f.pos, t.idf
    FROM (SELECT user_id, q_id, chunk_id, UNNEST(toks) AS token, generate_subscripts(toks, 1) AS pos FROM {name}_cand) f
    JOIN {name}_terms t USING (user_id, q_id, token)),
{name}_hit AS (SELECT user_id, q_id, chunk_id, SUM(idf) AS hit, COUNT(*) AS n_matched
    FROM (SELECT DISTINCT user_id, q_id, chunk_id, token, idf FROM {name}_pos) GROUP BY ALL),
{name}_last AS (SELECT r.user_id, r.q_id, r.chunk_id, r.pos, l.token, MAX(l.pos) AS last_pos
    FROM {name}_pos r JOIN {name}_pos l ON l.user_id = r.user_id AND l.q_id = r.q_id AND l.chunk_id = r.chunk_id AND l.pos <= r.pos
    GROUP BY ALL),
{name}_span AS (SELECT user_id, q_id, chunk_id, pos, pos - MIN(last_pos) + 1 AS span, COUNT(*) AS n FROM {name}_last
    GROUP BY user_id, q_id, chunk_id, pos),
{name}_win AS (SELECT s.user_id, s.q_id, s.chunk_id, MIN(span) AS win FROM {name}_span s
    JOIN {name}_hit h USING (user_id, q_id, chunk_id) WHERE s.n = h.n_matched GROUP BY ALL),
{name}_raw AS (SELECT c.user_id, c.q_id, c.chunk_id, coalesce(h.n_matched, 0) AS n_matched, w.win,
      coalesce(h.hit, 0) / CASE WHEN o.total = 0 THEN 1 ELSE o.total END AS cov,
      CASE WHEN h.n_matched > 1 THEN h.n_matched::DOUBLE / greatest(w.win, h.n_matched)
           WHEN h.n_matched = 1 THEN {V.RERANK_SINGLE_PROXIMITY} ELSE 0 END AS prox,
      CASE WHEN len(q.toks) > 0 AND contains(array_to_string(c.toks, ' '), array_to_string(q.toks, ' '))
           THEN {V.RERANK_PHRASE_BONUS} ELSE 0 END AS bonus, len(c.toks) AS dl
    FROM {name}_cand c JOIN {name}_toks q USING (user_id, q_id) LEFT JOIN {name}_total o USING (user_id, q_id)
    LEFT JOIN {name}_hit h USING (user_id, q_id, chunk_id) LEFT JOIN {name}_win w USING (user_id, q_id, chunk_id)),
{name} AS (SELECT user_id, q_id, chunk_id, n_matched, win,
      CASE WHEN dl = 0 OR cov IS NULL THEN 0.0 ELSE
      round(least(1.0, greatest(0.0, {V.RERANK_COVERAGE} * cov + {V.RERANK_PROXIMITY} * cov * prox + bonus)), 6) END AS rerank_score
    FROM {name}_raw)"""


TOKS = f"tok AS (SELECT user_id, chunk_id, {S.tokens(S.embed_text())} AS toks FROM chunks_v)"
SPARSE = f"{S.INDEX}, {S.bm25('questions_v')}"
FUSED = f"{SPARSE}, {S.DENSE}, {S.FUSED}"

# --- index ------------------------------------------------------------------------------


@query("tokenize", f"""WITH {TOKS}
    SELECT chunk_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS token_hash FROM tok""")
def tokenize(t):
    tok = R.index_tokens(t("chunks_v"))
    return tok.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("token_hash"))


@query("postings", f"WITH {S.INDEX} SELECT user_id, chunk_id, token, tf, dl FROM post")
def postings(t):
    post = R.postings(R.index_tokens(t("chunks_v")))
    return post.select("user_id", "chunk_id", "token", "tf", F.col("dl").cast("long").alias("dl"))


@query("bm25_topk", f"WITH {SPARSE} SELECT user_id, q_id, chunk_id, rank, score FROM sparse")
def bm25_topk(t):
    return sparse_lists(t).withColumn("rank", F.col("rank").cast("long"))


def vector_lists_sql(limit: str = "") -> str:
    return f"""SELECT user_id, q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q_id ORDER BY score DESC, chunk_id) - 1 AS rank
      FROM (SELECT q.user_id, q.q_id, c.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score
            FROM vector_queries_v q JOIN chunk_vectors_v c USING (user_id) {limit})) WHERE rank < {V.DENSE_TOP_K}"""


@query("dense_topk", vector_lists_sql())
def dense_topk(t):
    asked = t("vector_queries_v").drop("want_course", "want_chapter")
    return R.dense_topk(asked, t("chunk_vectors_v")).withColumn("rank", F.col("rank").cast("long"))


@query("dense_scoped", vector_lists_sql("WHERE (want_course IS NULL OR want_course = c.course_id) AND (want_chapter IS NULL OR want_chapter = c.chapter_num)"))
def dense_scoped(t):
    """The same within a course, a chapter, or both, where the query asks for it."""
    return R.dense_topk(t("vector_queries_v"), t("chunk_vectors_v")).withColumn("rank", F.col("rank").cast("long"))


@query("l2_normalise", """
    SELECT vec_id, pos, round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS x FROM (
      SELECT vec_id, UNNEST(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos,
             sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS norm FROM embeddings)""")
def l2_normalise(t):
    unit = R.l2_normalise(t("embeddings"))
    flat = unit.select("vec_id", F.posexplode("embedding"))
    return flat.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("col", 6).alias("x"))


@query("scoped_topk", f"""WITH {S.INDEX},
    scoped_q AS (SELECT *, CASE WHEN q_id % 2 = 0 THEN CASE WHEN q_id % 4 = 0 THEN 'en' ELSE 'xx' END END AS want_course,
                        CASE WHEN q_id % 3 = 0 THEN q_id % 20 END AS want_chapter FROM questions_v),
    terms AS (SELECT user_id, q_id, want_course, want_chapter, token, COUNT(*) AS n FROM
        (SELECT user_id, q_id, want_course, want_chapter, UNNEST({S.tokens('q')}) AS token FROM scoped_q) GROUP BY ALL),
    sums AS (SELECT t.user_id, t.q_id, p.chunk_id, {S.exact_sum(
        f"t.n * i.idf * (p.tf * ({V.BM25_K1} + 1)) / (p.tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * p.dl / c.avgdl))")} AS raw
      FROM terms t JOIN idf i USING (user_id, token) JOIN post p USING (user_id, token) JOIN corpus c USING (user_id)
      JOIN chunks_v k ON k.chunk_id = p.chunk_id
      WHERE (t.want_course IS NULL OR t.want_course = k.course_id) AND (t.want_chapter IS NULL OR t.want_chapter = k.chapter_num)
      GROUP BY ALL),
    ranked AS (SELECT * FROM (SELECT user_id, q_id, chunk_id, round(raw, 4) AS score,
        row_number() OVER (PARTITION BY user_id, q_id ORDER BY round(raw, 4) DESC, chunk_id) - 1 AS rank FROM sums WHERE raw > 0) WHERE rank < 50)
    SELECT s.user_id, s.q_id, r.chunk_id, r.rank, r.score,
           CASE WHEN EXISTS (SELECT 1 FROM chunks_v k WHERE k.user_id = s.user_id
                 AND (s.want_course IS NULL OR s.want_course = k.course_id) AND (s.want_chapter IS NULL OR s.want_chapter = k.chapter_num))
                THEN '' ELSE 'no materials loaded' END AS reason
    FROM scoped_q s LEFT JOIN ranked r USING (user_id, q_id)""")
def scoped_topk(t):
    """Search limited to a course and/or chapter; an empty scope is a refused row with a reason."""
    index = index_of(t)
    course = F.when(F.col("q_id") % 2 == 0, F.when(F.col("q_id") % 4 == 0, "en").otherwise("xx"))
    chapter = F.when(F.col("q_id") % 3 == 0, F.col("q_id") % 20)
    asked = t("questions_v").withColumns({"want_course": course, "want_chapter": chapter})
    hits = R.bm25_topk(asked, index, KEY)
    # what exists, per course and chapter and rolled up over either: a small lookup of scopes
    chunks = t("chunks_v").select("user_id", "course_id", "chapter_num")
    scopes = chunks.cube("user_id", "course_id", "chapter_num").agg(F.count("*").alias("n_chunks")).where("user_id IS NOT NULL")
    scopes = scopes.selectExpr("user_id AS s_user", "course_id AS s_course", "chapter_num AS s_chapter", "n_chunks")
    known = asked.join(
        scopes,
        (F.col("user_id") == F.col("s_user")) & F.col("want_course").eqNullSafe(F.col("s_course")) & F.col("want_chapter").eqNullSafe(F.col("s_chapter")),
        "left",
    )
    reason = F.when(F.col("n_chunks").isNull(), "no materials loaded").otherwise("")
    known = known.select(*KEY, reason.alias("reason"))
    out = known.join(hits, KEY, "left")
    return out.select(*KEY, "chunk_id", F.col("rank").cast("long").alias("rank"), "score", "reason")


@query("rrf_fuse", f"WITH {FUSED} SELECT user_id, q_id, chunk_id, fused_rank, rrf_score FROM fused")
def rrf_fuse(t):
    return fused_lists(t).withColumn("fused_rank", F.col("fused_rank").cast("long"))


@query("first_positions", f"""WITH {SPARSE}, {S.DENSE},
    l AS (SELECT user_id, q_id, chunk_id, rank, 0 AS n FROM sparse UNION ALL SELECT user_id, q_id, chunk_id, rank, 1 FROM dense)
    SELECT user_id, q_id, chunk_id, arg_min(rank, n) AS rank FROM l GROUP BY ALL""")
def first_positions(t):
    return R.first_positions(both_lists(t), KEY).withColumn("rank", F.col("rank").cast("long"))


# --- decomposition -------------------------------------------------------------------------

_TRIM = r"'^\s+|\s+$'"


def clean_sql(x: str) -> str:
    def bare(v):
        return f"regexp_replace(regexp_replace({v}, {_TRIM}, '', 'g'), '^[.!,: ]+|[.!,: ]+$', '', 'g')"

    leads = "|".join(p.removeprefix("^") for p in (V.LEAD_FRAMING, V.LEAD_ARTICLE, V.LEAD_EXAMPLE_OF))
    lead = f"regexp_replace({bare(x)}, {S.literal(f'(?i)^(?:{leads})+')}, '')"
    return bare(f"regexp_replace({lead}, {S.literal('(?i)' + V.TRAIL_FILLER)}, '', 'g')")


_IMPERATIVES = r"give|explain|show|tell|describe|list|walk|define|how\b|why\b|what\b|when\b|where\b"
_SPLIT = (
    "string_split(regexp_replace(regexp_replace(regexp_replace(whole, "
    + S.literal(rf"\s+and\s+({_IMPERATIVES})") + r", chr(1) || '\1', 'gi'), "
    + S.literal(r",\s+((?:how|why|what|give|explain|define|show|tell)\b)") + r", chr(1) || '\1', 'gi'), '[?;\n]+', chr(1), 'g'), chr(1))"
)
HOW = f"({S.has('c', V.WANTS_EXAMPLE)} OR {S.has('c', V.WANTS_APPLICATION)})"
DECOMPOSE = f"""
whole_q AS (SELECT user_id, q_id, regexp_replace(coalesce(q, ''), {_TRIM}, '', 'g') AS whole FROM phrased_v),
split_q AS (SELECT user_id, q_id, whole, list_filter(list_transform({_SPLIT}, lambda c: regexp_replace(c, {_TRIM}, '', 'g')), lambda c: c <> '') AS cs FROM whole_q),
clause AS (SELECT user_id, q_id, whole, UNNEST(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM split_q),
cleaned AS (SELECT *, {clean_sql('c')} AS txt, {HOW} AS how FROM clause),
firsts AS (SELECT user_id, q_id, arg_min(txt, i) AS first_txt FROM cleaned
           WHERE length(txt) >= 3 AND (NOT how OR i = 0) AND len({S.words('txt')}) <= {V.CONCEPT_MAX_WORDS} GROUP BY ALL),
parsed AS (SELECT s.user_id, s.q_id, s.whole, len(s.cs) AS n_clauses, {S.has('whole', V.WANTS_EXAMPLE)} AS ex, {S.has('whole', V.WANTS_APPLICATION)} AS app,
           coalesce(f.first_txt, CASE WHEN {clean_sql('whole')} <> '' THEN {clean_sql('whole')} ELSE whole END) AS concept
           FROM split_q s LEFT JOIN firsts f USING (user_id, q_id)),
extras AS (SELECT c.user_id, c.q_id, c.i, c.txt FROM cleaned c JOIN parsed p USING (user_id, q_id)
           WHERE c.i > 0 AND c.txt <> '' AND NOT c.how AND lower(c.txt) <> lower(p.concept)),
n_extra AS (SELECT user_id, q_id, COUNT(*) AS n FROM extras GROUP BY ALL),
judged AS (SELECT p.*, (n_clauses <= 1 AND NOT ex AND NOT app AND coalesce(n, 0) = 0) AS single FROM parsed p LEFT JOIN n_extra USING (user_id, q_id)),
subs0 AS (SELECT user_id, q_id, 0 AS k, 0 AS i, CASE WHEN single THEN whole ELSE concept END AS sub, {V.CONCEPT_WEIGHT}::DOUBLE AS weight, 'concept' AS kind FROM judged WHERE whole <> ''
  UNION ALL SELECT user_id, q_id, 1, 0, concept || ' real world application', 1.0, 'application' FROM judged WHERE app AND NOT single
  UNION ALL SELECT user_id, q_id, 2, 0, concept || ' example', 1.0, 'example' FROM judged WHERE ex AND NOT single
  UNION ALL SELECT user_id, q_id, 3, i, txt, 1.0, 'part' FROM extras),
subs AS (SELECT user_id, q_id, row_number() OVER (PARTITION BY user_id, q_id ORDER BY k, i) - 1 AS sub_no, sub, weight, kind,
         COUNT(*) OVER (PARTITION BY user_id, q_id) AS n_subs FROM subs0)"""


def subqueries(t):
    parsed = t("phrased_v").withColumn("d", X.decompose(F.col("q")))
    return parsed.select(*KEY, F.posexplode("d.subqueries").alias("sub_no", "s"), "d.is_compound").select(
        *KEY, "sub_no", F.col("s.text").alias("sub"), "s.weight", "s.kind", "is_compound"
    )


@query("decompose", f"WITH {DECOMPOSE} SELECT user_id, q_id, sub_no, sub, weight, kind FROM subs")
def decompose(t):
    return subqueries(t).select(*KEY, F.col("sub_no").cast("long").alias("sub_no"), "sub", "weight", "kind")


def used_sql(course: str = "NULL::VARCHAR", chapter: str = "NULL::BIGINT") -> str:
    """CTE used (user_id, q_id, sub_no, q, weight, want_course, want_chapter): the texts that are searched for each question."""
    return f"""used AS (SELECT p.user_id, p.q_id, coalesce(s.sub_no, 0) AS sub_no, coalesce(s.sub, p.q) AS q, coalesce(s.weight, 1.0::DOUBLE) AS weight,
        {course} AS want_course, {chapter} AS want_chapter
      FROM searched_v p LEFT JOIN (SELECT s.* FROM subs s JOIN judged j USING (user_id, q_id) WHERE s.n_subs > 1 AND NOT j.single) s USING (user_id, q_id))"""


MIXED = f"""mix AS (SELECT user_id, q_id, chunk_id, round({S.exact_sum(f"weight / ({V.RRF_K} + rank + 1)")}, 8) AS rrf_score
    FROM (SELECT user_id, q_id, sub_no, chunk_id, rank FROM sparse UNION ALL SELECT user_id, q_id, sub_no, chunk_id, rank FROM dense) JOIN used USING (user_id, q_id, sub_no) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT user_id, q_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY user_id, q_id ORDER BY rrf_score DESC, chunk_id) - 1 AS fused_rank FROM mix)
    WHERE fused_rank < {V.FUSED_TOP_K})"""


@query("compound_search", f"""WITH {S.INDEX}, {DECOMPOSE}, {used_sql()}, {S.bm25('used', 'q_id, sub_no')}, {S.encoded_lists()}, {MIXED} SELECT * FROM fused""")
def compound_search(t):
    """Sparse and dense lists per sub-query, fused with the sub-queries' weights."""
    subs = R.subquery_rows(t("searched_v"), R.SearchConfig())
    lists = R.retrieval_lists(subs, index_of(t), R.build_dense_index(t("chunks_v")), R.SearchConfig())
    return R.rrf(lists, KEY).withColumn("fused_rank", F.col("fused_rank").cast("long"))


# --- rerank ----------------------------------------------------------------------------------


@query("lexical_rerank", f"WITH {FUSED}, {rerank_sql('fused')} SELECT user_id, q_id, chunk_id, rerank_score FROM reranked")
def lexical_rerank(t):
    index = index_of(t)
    scored = R.lexical_rerank(fused_lists(t, index), t("questions_v"), index, KEY)
    return scored.select(*KEY, "chunk_id", "rerank_score")


@query("min_window", f"WITH {SPARSE}, {rerank_sql('sparse')} SELECT user_id, q_id, chunk_id, n_matched, win FROM reranked")
def min_window(t):
    index = index_of(t)
    hits = sparse_lists(t, index).select(*KEY, "chunk_id")
    terms = R.rerank_terms(t("questions_v"), index, KEY)
    joined = hits.join(terms, KEY).join(index.tokens.select("user_id", "chunk_id", "tokens"), ["user_id", "chunk_id"])
    names = F.transform("terms", lambda x: x["token"])
    return joined.select(*KEY, "chunk_id", F.size(F.array_intersect(names, "tokens")).cast("long").alias("n_matched"), R.min_window(F.col("tokens"), names).alias("win"))


TITLE = f"""title_sim AS (SELECT f.user_id, f.q_id, f.chunk_id, f.rrf_score, f.fused_rank, r.rerank_score,
      {S.set_similarity('qt', 'ct')} AS sim
    FROM fused f JOIN reranked r USING (user_id, q_id, chunk_id)
    JOIN (SELECT user_id, q_id, {S.title_tokens('q')} AS qt FROM questions_v) q USING (user_id, q_id)
    JOIN (SELECT user_id, chunk_id, {S.title_tokens('chapter_title')} AS ct FROM chunks_v) c USING (user_id, chunk_id))"""


def final_sql(score: str, name: str, boost: float = 0.0) -> str:
    return (
        f"SELECT '{name}' AS policy, user_id, q_id, chunk_id, row_number() OVER (PARTITION BY user_id, q_id "
        f"ORDER BY round({score} + {boost} * sim, 6) DESC, fused_rank) - 1 AS final_rank FROM title_sim"
    )


POLICIES = [("rank", "rerank_score"), ("confidence", "rrf_score"), ("none", "rrf_score")]


def reranked_pool(t, index=None):
    """Fused candidates with reranker score and title similarity."""
    index = index or index_of(t)
    scored = R.lexical_rerank(fused_lists(t, index), t("questions_v"), index, KEY)
    asked = t("questions_v").select(*KEY, X.title_tokens(F.col("q")).alias("qt"))
    titles = t("chunks_v").select("user_id", "chunk_id", X.title_tokens(F.col("chapter_title")).alias("ct"))
    pool = scored.join(asked, KEY).join(titles, ["user_id", "chunk_id"])
    return pool.withColumn("title_sim", X.set_similarity(F.col("qt"), F.col("ct"))).drop("qt", "ct")


def _policy_rows(pool, name, config):
    out = R.order_candidates(pool, KEY, config)
    return out.select(F.lit(name).alias("policy"), *KEY, "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


@query("rerank_modes", f"WITH {FUSED}, {rerank_sql('fused')}, {TITLE} SELECT * FROM ("
       + " UNION ALL ".join(final_sql(score, name) for name, score in POLICIES) + ") WHERE final_rank < 6")
def rerank_modes(t):
    pool = reranked_pool(t)
    configs = {
        "rank": R.SearchConfig(title_boost=0.0),
        "confidence": R.SearchConfig(rerank_mode="confidence", title_boost=0.0),
        "none": R.SearchConfig(use_rerank=False, title_boost=0.0),
    }
    rows = [_policy_rows(pool, name, config) for name, config in configs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("title_boost", f"WITH {FUSED}, {rerank_sql('fused')}, {TITLE} SELECT * FROM ({final_sql('rerank_score', 'boost', V.TITLE_BOOST)}) WHERE final_rank < 6")
def title_boost(t):
    return _policy_rows(reranked_pool(t), "boost", R.SearchConfig())


@query("title_similarity", f"""
    SELECT chunk_id, round({S.set_similarity('a', 'b')}, 6) AS sim FROM (
      SELECT c.chunk_id, {S.title_tokens('c.text')} AS a, {S.title_tokens('c.chapter_title')} AS b FROM chunks_v c)""")
def title_similarity(t):
    sim = X.title_similarity(F.col("text"), F.col("chapter_title"))
    return t("chunks_v").select("chunk_id", sql_round(sim, 6).alias("sim"))


@query("chapter_titles", """SELECT user_id, course_id, chapter_num, arg_min(chapter_title, ordinal) AS title
    FROM chunks_v WHERE chapter_num <> 0 AND chapter_title <> '' GROUP BY ALL""")
def chapter_titles(t):
    return R.chapter_titles(t("chunks_v"))


@query("hydrate_parents", f"""WITH {SPARSE},
    parents AS (SELECT user_id, ordinal // 12 AS parent_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS parent_text FROM chunks_v GROUP BY ALL)
    SELECT s.user_id, s.q_id, s.chunk_id, s.rank, md5(c.text) AS text_hash, md5(p.parent_text) AS parent_hash
    FROM sparse s JOIN chunks_v c USING (user_id, chunk_id) LEFT JOIN parents p ON p.user_id = c.user_id AND p.parent_id = c.ordinal // 12 WHERE rank < 6""")
def hydrate_parents(t):
    chunks, parents = parents_of(t)
    out = R.hydrate(sparse_lists(t).where("rank < 6"), chunks, parents)
    return out.select(
        *KEY, "chunk_id", F.col("rank").cast("long").alias("rank"), F.md5(F.col("text").cast("binary")).alias("text_hash"),
        F.md5(F.col("parent_text").cast("binary")).alias("parent_hash"),
    )


# --- refusal ---------------------------------------------------------------------------------------


def confidences(t, index=None):
    """(user_id, q_id, confidence): best reranker score of the fused pool, 0 without candidates."""
    index = index or index_of(t)
    scored = R.lexical_rerank(fused_lists(t, index), t("questions_v"), index, KEY)
    best = scored.groupBy(*KEY).agg(F.max("rerank_score").alias("best"))
    return t("questions_v").join(best, KEY, "left").select(*KEY, "slice", F.coalesce("best", F.lit(0.0)).alias("confidence"))


CONFIDENCE = f"""{FUSED}, {rerank_sql('fused')},
conf AS (SELECT q.user_id, q.q_id, q.slice, coalesce(MAX(r.rerank_score), 0.0) AS confidence
         FROM questions_v q LEFT JOIN reranked r USING (user_id, q_id) GROUP BY ALL)"""


@query("refusal_decision", f"""WITH {CONFIDENCE} SELECT user_id, q_id, confidence, confidence < {V.REFUSAL_THRESHOLD} AS refused,
    CASE WHEN confidence < {V.REFUSAL_THRESHOLD} THEN printf('top passage scored %.2f, below the calibrated threshold of {V.REFUSAL_THRESHOLD:.2f}', confidence) ELSE '' END AS reason FROM conf""")
def refusal_decision(t):
    return R.refusal_decision(confidences(t)).drop("slice")


def intent_sql(q: str) -> str:
    classes = [("out_of_scope", V.INTENT_ADMINISTRATIVE), ("out_of_scope", V.INTENT_TASK), ("out_of_scope", V.INTENT_OFFICE_HOLDER),
               ("needs_live_data", V.INTENT_TEMPORAL), ("quantitative_request", V.INTENT_QUANTITATIVE)]
    name = " ".join(f"WHEN {S.has(q, p)} THEN '{n}'" for n, p in classes)
    phrase = " ".join(f"WHEN {S.has(q, p)} THEN regexp_extract({q}, {S.literal('(?i)' + p)}, 0)" for _, p in classes)
    return f"CASE {name} ELSE 'answerable' END AS intent, CASE {phrase} ELSE '' END AS phrase"


@query("intent_gate", f"SELECT user_id, q_id, {intent_sql('q')} FROM phrased_v")
def intent_gate(t):
    return R.question_intent(t("phrased_v")).select(*KEY, "intent", "phrase")


GATE = f"""gate AS (SELECT p.user_id, p.q_id, p.course_id, p.q, i.intent,
      CASE WHEN p.course_id IS NULL THEN true ELSE coalesce(c.has_data_link, false) END AS has_link
    FROM phrased_v p JOIN (SELECT user_id, q_id, {intent_sql('q')} FROM phrased_v) i USING (user_id, q_id)
    LEFT JOIN courses_v c ON c.user_id = p.user_id AND c.course_id = p.course_id),
gated AS (SELECT *, intent IN ('out_of_scope', 'needs_live_data') OR (intent = 'quantitative_request' AND NOT has_link) AS gate_refused FROM gate)"""


@query("gate_compose", f"WITH {GATE} SELECT user_id, q_id, intent, has_link, gate_refused FROM gated")
def gate_compose(t):
    return R.intent_gate(t("phrased_v"), t("courses_v")).select(*KEY, "intent", "has_link", "gate_refused")


RANGE = f"""highest AS (SELECT user_id, course_id, MAX(chapter_num) AS highest FROM chunks_v WHERE chapter_num <> 0 GROUP BY ALL
    UNION ALL SELECT user_id, NULL, MAX(chapter_num) FROM chunks_v WHERE chapter_num <> 0 GROUP BY user_id),
ranged AS (SELECT p.user_id, p.q_id, h.highest, list_filter({S.mentions('q')}, lambda n: n > h.highest)[1] AS beyond_chapter
    FROM phrased_v p LEFT JOIN highest h ON h.user_id = p.user_id AND h.course_id IS NOT DISTINCT FROM p.course_id)"""


@query("chapter_range_check", f"WITH {RANGE} SELECT user_id, q_id, highest, beyond_chapter FROM ranged")
def chapter_range_check(t):
    return R.chapter_range_check(t("phrased_v"), t("chunks_v")).select(*KEY, "highest", "beyond_chapter")


SEARCH = f"""{S.INDEX}, {DECOMPOSE}, {used_sql('p.course_id', 'p.chapter_num')}, {S.bm25('used', 'q_id, sub_no', scoped=True)}, {S.encoded_lists()}, {MIXED},
concepts AS (SELECT user_id, q_id, concept AS q FROM judged JOIN (SELECT DISTINCT user_id, q_id, n_subs FROM subs) USING (user_id, q_id) WHERE n_subs > 1 AND NOT single AND concept <> ''),
cfused AS (SELECT f.* FROM fused f JOIN concepts USING (user_id, q_id)),
{rerank_sql('fused', 'searched_v', name='rr')}, {rerank_sql('cfused', 'concepts', name='rc')},
abouts AS (SELECT p.user_id, p.q_id, {S.title_tokens("CASE WHEN j.whole <> '' AND j.concept <> '' THEN j.concept ELSE p.q END")} AS qt FROM searched_v p JOIN judged j USING (user_id, q_id)),
heads AS (SELECT * FROM (SELECT f.user_id, f.q_id, f.chunk_id, r.rerank_score, row_number() OVER (PARTITION BY f.user_id, f.q_id
      ORDER BY round(r.rerank_score + {V.TITLE_BOOST} * {S.set_similarity('qt', 'ct')}, 6) DESC, f.fused_rank) - 1 AS final_rank
    FROM fused f JOIN rr r USING (user_id, q_id, chunk_id) JOIN abouts USING (user_id, q_id)
    JOIN (SELECT user_id, chunk_id, {S.title_tokens('chapter_title')} AS ct FROM chunks_v) c USING (user_id, chunk_id)) WHERE final_rank < {V.FINAL_TOP_K}),
first_sparse AS (SELECT user_id, q_id, chunk_id, arg_min(rank, sub_no) AS sparse_rank FROM sparse GROUP BY ALL),
first_dense AS (SELECT user_id, q_id, chunk_id, arg_min(rank, sub_no) AS dense_rank FROM dense GROUP BY ALL),
parents AS (SELECT user_id, ordinal // 12 AS parent_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS parent_text FROM chunks_v GROUP BY ALL),
shown AS (SELECT h.*, s.sparse_rank, d.dense_rank, md5(p.parent_text) AS parent_hash FROM heads h JOIN chunks_v c USING (user_id, chunk_id)
    LEFT JOIN first_sparse s USING (user_id, q_id, chunk_id) LEFT JOIN first_dense d USING (user_id, q_id, chunk_id)
    LEFT JOIN parents p ON p.user_id = c.user_id AND p.parent_id = c.ordinal // 12),
{GATE}, {RANGE},
conf AS (SELECT p.user_id, p.q_id, MAX(r.rerank_score) AS whole_confidence FROM searched_v p LEFT JOIN rr r USING (user_id, q_id) GROUP BY ALL),
cconf AS (SELECT user_id, q_id, MAX(rerank_score) AS concept_confidence FROM rc GROUP BY ALL),
facts AS (SELECT p.user_id, p.q_id, p.course_id, g.intent, i.phrase, g.gate_refused AS gated, r.beyond_chapter, r.highest,
      coalesce(cc.concept_confidence, c.whole_confidence, 0.0) AS score,
      NOT EXISTS (SELECT 1 FROM chunks_v k WHERE k.user_id = p.user_id AND (p.course_id IS NULL OR k.course_id = p.course_id)
                  AND (p.chapter_num IS NULL OR k.chapter_num = p.chapter_num)) AS empty,
      NOT EXISTS (SELECT 1 FROM mix m WHERE m.user_id = p.user_id AND m.q_id = p.q_id) AS lost
    FROM searched_v p JOIN gated g USING (user_id, q_id) JOIN (SELECT user_id, q_id, {intent_sql('q')} FROM phrased_v) i USING (user_id, q_id)
    JOIN ranged r USING (user_id, q_id) JOIN conf c USING (user_id, q_id) LEFT JOIN cconf cc USING (user_id, q_id)),
verdicts AS (SELECT user_id, q_id, course_id, intent, beyond_chapter, CASE WHEN empty OR lost OR beyond_chapter IS NOT NULL THEN 0.0 ELSE score END AS confidence,
      NOT empty AND NOT lost AND (gated OR beyond_chapter IS NOT NULL) AS gate_refused,
      CASE WHEN empty THEN 'no materials loaded' WHEN lost THEN 'no candidates retrieved'
           WHEN beyond_chapter IS NOT NULL THEN printf('chapter %d is beyond the last chapter, %d', beyond_chapter, highest)
           WHEN gated THEN intent || ': ' || lower(phrase)
           WHEN score < {V.REFUSAL_THRESHOLD} THEN printf('top passage scored %.2f, below the calibrated threshold of {V.REFUSAL_THRESHOLD:.2f}', score) ELSE '' END AS reason
    FROM facts)"""


def parents_of(t):
    """Chunks with the key of their parent, and parents: the texts of twelve neighbouring documents of a tenant."""
    chunks = t("chunks_v").withColumn("parent_id", F.floor(F.col("ordinal") / 12))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks, chunks.groupBy("user_id", "parent_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


@query("search_batch", f"""WITH {SEARCH} SELECT v.*, v.reason <> '' AS refused, s.chunk_id, s.final_rank, s.rerank_score, s.sparse_rank, s.dense_rank, s.parent_hash
    FROM verdicts v LEFT JOIN shown s USING (user_id, q_id)""")
def search_batch(t):
    """Full search of the phrased questions, some within a chapter: ranked passages with the verdict on each question."""
    chunks, parents = parents_of(t)
    dense = R.build_dense_index(chunks)
    passages, verdicts = R.search_batch(t("searched_v"), chunks, t("courses_v"), parents, dense, index=index_of(t))
    ranks = [F.col(c).cast("long").alias(c) for c in ("final_rank", "sparse_rank", "dense_rank")]
    shown = passages.select(*KEY, "chunk_id", *ranks, "rerank_score", F.md5(F.col("parent_text").cast("binary")).alias("parent_hash"))
    return verdicts.join(shown, KEY, "left")


# --- evidence series ------------------------------------------------------------------------------------

SERIES = """
    series_src AS (SELECT 'S' || (l_suppkey % 100) AS series_id, CASE WHEN l_suppkey % 3 = 0 THEN 'Percent' ELSE 'Index 1995=100' END AS units,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {total} AS value FROM lineitem GROUP BY 1, 2, 3)"""


@query("series_transform", f"""WITH {SERIES.format(total="CAST(SUM(CAST(l_quantity AS DECIMAL(38,12))) AS DOUBLE)")}
    SELECT series_id, CAST(month AS VARCHAR) AS month, CASE WHEN units ILIKE '%percent%' THEN 'level' ELSE 'yoy' END AS transform,
           round(CASE WHEN units ILIKE '%percent%' THEN value ELSE 100 * (value / nullif(lag(value, 12) OVER (PARTITION BY series_id ORDER BY month), 0) - 1) END, 6) AS shown
    FROM series_src""")
def series_transform(t):
    li = t("lineitem")
    units = F.when(F.col("l_suppkey") % 3 == 0, "Percent").otherwise("Index 1995=100")
    series = li.groupBy(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 100).cast("string")).alias("series_id"), units.alias("units"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("month"),
    ).agg(exact_sum(F.col("l_quantity")).alias("value"))
    out = R.series_transform(series)
    return out.select("series_id", F.col("month").cast("string").alias("month"), "transform", F.round("shown", 6).alias("shown"))


EVIDENCE_HITS = """SELECT concat('concept ', l_partkey % 40) AS query, l_suppkey % 7 AS hit_no, concat('S', l_suppkey % 100) AS series_id
    FROM {lineitem} GROUP BY 1, 2, 3"""
EVIDENCE_PROPOSALS = """SELECT user_id, q_id, proposal_no, eligible,
           CASE WHEN (q_id + proposal_no) % 11 = 0 THEN 'UNRATE' WHEN (q_id + proposal_no) % 13 = 0 THEN ''
                ELSE concat('concept ', (q_id + proposal_no * (q_id % 3)) % 45) END AS query
    FROM (SELECT user_id, q_id, 1 AS proposal_no, course_id IS NULL OR course_id <> 'de' AS eligible FROM {asked_v}
          UNION ALL SELECT user_id, q_id, 2, course_id IS NULL OR course_id <> 'de' FROM {asked_v}
          UNION ALL SELECT user_id, q_id, 3, course_id IS NULL OR course_id <> 'de' FROM {asked_v}) p"""


def _plain(sql):
    return sql.replace("{", "").replace("}", "")


@query("evidence_select", f"""WITH proposals AS ({_plain(EVIDENCE_PROPOSALS)}), hits AS ({_plain(EVIDENCE_HITS)}),
    live AS (SELECT DISTINCT 'S' || (l_suppkey % 100) AS series_id FROM lineitem WHERE l_suppkey % 4 <> 0),
    usable AS (SELECT user_id, q_id, query, MIN(proposal_no) AS proposal_no FROM proposals
               WHERE eligible AND query <> '' AND NOT regexp_matches(query, '^[A-Z0-9]{{3,20}}$') GROUP BY ALL),
    o AS (SELECT u.*, h.hit_no, h.series_id FROM usable u JOIN hits h USING (query) WHERE h.series_id IN (SELECT series_id FROM live)),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q_id ORDER BY proposal_no, hit_no, series_id) AS r FROM o) WHERE r = 1),
    two AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.user_id, o.q_id ORDER BY o.proposal_no, o.hit_no, o.series_id) AS r
            FROM o JOIN one ON one.user_id = o.user_id AND one.q_id = o.q_id AND o.proposal_no > one.proposal_no AND o.series_id <> one.series_id) WHERE r = 1)
    SELECT user_id, q_id, proposal_no, query, series_id, 1 AS slot FROM one UNION ALL SELECT user_id, q_id, proposal_no, query, series_id, 2 FROM two""")
def evidence_select(t):
    hits = t.spark.sql(EVIDENCE_HITS, lineitem=t("lineitem"))
    proposals = t.spark.sql(EVIDENCE_PROPOSALS, asked_v=t("asked_v"))
    live = t("lineitem").where("l_suppkey % 4 <> 0").selectExpr("concat('S', l_suppkey % 100) AS series_id")
    out = R.evidence_select(proposals, hits, live)
    return out.select(*KEY, "proposal_no", "query", "series_id", "slot")
