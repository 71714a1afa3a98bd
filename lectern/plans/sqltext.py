"""SQL text for the text expressions, used by the SQL counterparts of the queries."""

from __future__ import annotations

from lectern.functions import fixed_values as V
from lectern.operators import features as FE


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = quoted(V.SEARCH_STOPWORDS)


def stem(w: str) -> str:
    cases = []
    for suffix, shortest, replacement in V.STEM_SUFFIXES:
        cut = len(suffix)
        cases.append(
            f"WHEN suffix({w}, '{suffix}') AND length({w}) >= {shortest} "
            f"AND length({w}) - {cut - len(replacement)} >= {V.STEM_MIN_BASE} "
            f"THEN substr({w}, 1, length({w}) - {cut}) || '{replacement}'"
        )
    return f"CASE WHEN length({w}) < {V.STEM_MIN_TOKEN} THEN NULL {' '.join(cases)} END"


def _emit(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 2 OR {w} IN ({STOP}) THEN []::VARCHAR[] "
        f"ELSE list_filter([{w}, {stem(w)}], lambda z: z IS NOT NULL) END"
    )


def tokens(text: str) -> str:
    return (
        f"flatten(list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{V.TOKEN_PATTERN}'), "
        f"lambda w: w NOT IN ({STOP})), lambda w: list_concat({_emit('w')}, "
        f"CASE WHEN regexp_matches(w, '[-.]') THEN flatten(list_transform(string_split_regex(w, '[-.]'), "
        f"lambda p: {_emit('p')})) ELSE []::VARCHAR[] END)))"
    )


def title_tokens(text: str) -> str:
    return f"list_distinct({tokens(f'''regexp_replace(coalesce({text}, ''), {literal(V.CHAPTER_REF_IN_TITLE)}, ' ', 'gi')''')})"


def set_similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN {shared} > 0 THEN 0.5 * ({shared}::DOUBLE / (len({a}) + len({b}) - {shared})) "
        f"+ 0.5 * ({shared}::DOUBLE / least(len({a}), len({b}))) ELSE 0.0::DOUBLE END"
    )


def embed_text() -> str:
    return (
        "'[' || course_id || ' / Chapter ' || chapter_num || ': ' || chapter_title || "
        "CASE WHEN section <> '' THEN ' / ' || section ELSE '' END || '] ' || text"
    )


def words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: w <> '')"


def mentions(text: str) -> str:
    """Distinct chapter numbers named in the text, in order of first mention."""
    lists = ", ".join(f"regexp_extract_all(coalesce({text}, ''), {literal('(?i)' + p)}, 1)" for p in V.CHAPTER_MENTIONS)
    numbers = f"list_filter(list_transform(flatten([{lists}]), lambda n: n::INTEGER), lambda n: n > 0 AND n < 100)"
    return f"list_filter({numbers}, lambda n, i: list_position({numbers}, n) = i)"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({text}, ''), {literal('(?i)' + pattern)})"


def sentences(text: str) -> str:
    return f"string_split(regexp_replace(coalesce({text}, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def term_set(text: str, stopwords, shortest: int) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{V.TOKEN_PATTERN}'), "
        f"lambda t: length(t) >= {shortest} AND t NOT IN ({quoted(stopwords)})))"
    )


def exact_sum(value: str) -> str:
    return f"CAST(SUM(CAST({value} AS DECIMAL(38,12))) AS DOUBLE)"


# --- retrieval CTEs ---------------------------------------------------------------------

INDEX = f"""
tok AS (SELECT user_id, chunk_id, {tokens(embed_text())} AS toks FROM chunks_v),
post AS (SELECT user_id, chunk_id, token, COUNT(*) AS tf, ANY_VALUE(dl) AS dl
         FROM (SELECT user_id, chunk_id, len(toks) AS dl, UNNEST(toks) AS token FROM tok) GROUP BY ALL),
dfs AS (SELECT user_id, token, COUNT(*) AS df FROM post GROUP BY ALL),
corpus AS (SELECT user_id, COUNT(*) AS n_docs, SUM(len(toks))::DOUBLE / COUNT(*) AS avgdl FROM tok GROUP BY user_id),
raw_idf AS (SELECT d.user_id, d.token, d.df, ln(c.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS raw
            FROM dfs d JOIN corpus c USING (user_id)),
mean_idf AS (SELECT user_id, {exact_sum("raw")} / COUNT(*) AS mean FROM raw_idf GROUP BY user_id),
idf AS (SELECT r.user_id, r.token, r.df, CASE WHEN r.raw < 0 THEN {V.BM25_EPSILON} * m.mean ELSE r.raw END AS idf
        FROM raw_idf r JOIN mean_idf m USING (user_id))"""


def bm25(questions: str, key: str = "q_id", text: str = "q", k: int = V.SPARSE_TOP_K, name: str = "sparse", scoped: bool = False) -> str:
    """CTE `name` (user_id, key, chunk_id, rank, score) over INDEX; `scoped` keeps to want_course and want_chapter."""
    want = ", want_course, want_chapter" if scoped else ""
    limit = (
        """JOIN chunks_v k ON k.user_id = p.user_id AND k.chunk_id = p.chunk_id
    WHERE (t.want_course IS NULL OR t.want_course = k.course_id) AND (t.want_chapter IS NULL OR t.want_chapter = k.chapter_num)"""
        if scoped
        else ""
    )
    named = ", ".join(f"t.{k_}" for k_ in key.split(", "))
    return f"""
{name}_terms AS (SELECT user_id, {key}{want}, token, COUNT(*) AS n
    FROM (SELECT user_id, {key}{want}, UNNEST({tokens(text)}) AS token FROM {questions}) GROUP BY ALL),
{name}_scores AS (SELECT t.user_id, {named}, p.chunk_id, {exact_sum(
        f"t.n * i.idf * (p.tf * ({V.BM25_K1} + 1)) / (p.tf + {V.BM25_K1} * (1 - {V.BM25_B} + {V.BM25_B} * p.dl / c.avgdl))"
    )} AS raw_score
    FROM {name}_terms t JOIN idf i USING (user_id, token) JOIN post p USING (user_id, token) JOIN corpus c USING (user_id) {limit}
    GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT user_id, {key}, chunk_id, round(raw_score, 4) AS score,
        row_number() OVER (PARTITION BY user_id, {key} ORDER BY round(raw_score, 4) DESC, chunk_id) - 1 AS rank
    FROM {name}_scores WHERE raw_score > 0) WHERE rank < {k})"""


DENSE = f"""
dense AS (SELECT * FROM (SELECT user_id, q_id, chunk_id, score,
        row_number() OVER (PARTITION BY user_id, q_id ORDER BY score DESC, chunk_id) - 1 AS rank
    FROM (SELECT q.user_id, q.q_id, c.chunk_id,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score
          FROM query_vectors_v q JOIN chunk_vectors_v c USING (user_id))) WHERE rank < {V.DENSE_TOP_K})"""

FUSED = f"""
lists AS (SELECT user_id, q_id, chunk_id, rank FROM sparse UNION ALL SELECT user_id, q_id, chunk_id, rank FROM dense),
rrf AS (SELECT user_id, q_id, chunk_id, round({exact_sum(f"1.0 / ({V.RRF_K} + rank + 1)")}, 8) AS rrf_score FROM lists GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q_id ORDER BY rrf_score DESC, chunk_id) - 1 AS fused_rank
    FROM rrf) WHERE fused_rank < {V.FUSED_TOP_K})"""

GOLD = """
gold AS (SELECT q.user_id, q.q_id, q.slice, c.chunk_id FROM questions_v q JOIN chunks_v c
         ON c.user_id = q.user_id AND contains(c.text, q.q))"""


# --- TF-IDF CTEs ------------------------------------------------------------------------

_ACC = FE._accents()


def grams(name: str, source: str, key: str, text: str = "text") -> str:
    """CTE {name}_grams (key, kind, term, tf) of the texts of `source`."""
    some = f"FROM {source} WHERE trim({text}) <> ''"
    pieces = f"regexp_extract_all(translate(lower({text}), '{_ACC[0]}', '{_ACC[1]}'), '{FE.WORD_PATTERN}')"
    return f"""
{name}_ww AS (SELECT {key}, {pieces} AS w {some}),
{name}_cw AS (SELECT {key}, ' ' || w || ' ' AS w, COUNT(*) AS n FROM (SELECT {key}, UNNEST(string_split_regex(lower({text}), '\\s+')) AS w {some}) WHERE w <> '' GROUP BY ALL),
{name}_cz AS (SELECT *, UNNEST(range(3, least(5, length(w)) + 1)) AS k FROM {name}_cw),
{name}_cp AS (SELECT *, UNNEST(range(1, length(w) - k + 2)) AS i FROM {name}_cz),
{name}_grams AS (SELECT {key}, 'word' AS kind, term, COUNT(*) AS tf FROM (SELECT {key}, UNNEST(w) AS term FROM {name}_ww
    UNION ALL SELECT {key}, UNNEST(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM {name}_ww WHERE len(w) > 1) GROUP BY ALL
  UNION ALL SELECT {key}, 'char', substr(w, i, k) AS term, SUM(n) FROM {name}_cp GROUP BY ALL)"""


def vocabulary(source: str = "chunks_v") -> str:
    """CTE vocab (user_id, kind, term, idf) over chunk_grams, the features that each tenant's corpus keeps."""
    return f"""
sizes AS (SELECT user_id, COUNT(*) AS n_docs FROM {source} WHERE trim(text) <> '' GROUP BY ALL),
gram_stats AS (SELECT user_id, kind, term, COUNT(*) AS df, SUM(tf) AS total, ANY_VALUE(n_docs) AS n_docs FROM chunk_grams JOIN sizes USING (user_id) GROUP BY ALL),
vocab AS (SELECT user_id, kind, term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM gram_stats WHERE kind = 'word' AND (n_docs < 10 OR df <= {FE.MAX_SHARE} * n_docs)
  UNION ALL SELECT user_id, kind, term, ln((1 + n_docs) / (1 + df)) + 1 FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, term) AS place FROM gram_stats WHERE kind = 'char' AND n_docs >= 2 AND (n_docs < 10 OR df >= 2))
    WHERE place <= {FE.CHAR_FEATURES})"""


def gram_weights(name: str, key: str) -> str:
    """CTE {name}_w (key, kind, term, weight) over {name}_grams and vocab."""
    return f"""
{name}_raw AS (SELECT {', '.join('g.' + k for k in key.split(', '))}, g.kind, g.term, (1 + ln(g.tf)) * v.idf AS raw FROM {name}_grams g JOIN vocab v USING (user_id, kind, term)),
{name}_w AS (SELECT {key}, kind, term, raw / norm AS weight FROM {name}_raw JOIN
   (SELECT {key}, kind, sqrt({exact_sum('raw * raw')}) AS norm FROM {name}_raw GROUP BY ALL) n USING ({key}, kind))"""


def _wide(x: str, factor: int) -> str:
    return f"({x}::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _sign_ctes(blocks: int) -> str:
    def each(expression):
        return ", ".join(f"{expression(f'x{b}', b)} AS x{b}" for b in range(blocks))

    start = each(lambda x, b: f"((code::UHUGEINT + {(b + 1) * FE.GOLDEN % (1 << 64)}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT")
    return f"""
codes AS (SELECT kind, term, ('0x' || substr(md5(kind || ':' || term), 1, 16))::UBIGINT AS code FROM (SELECT DISTINCT kind, term FROM vocab)),
signs0 AS (SELECT kind, term, {start} FROM codes),
signs1 AS (SELECT kind, term, {each(lambda x, b: _wide(f'xor({x}, {x} >> 30)', FE.MIX_A))} FROM signs0),
signs2 AS (SELECT kind, term, {each(lambda x, b: _wide(f'xor({x}, {x} >> 27)', FE.MIX_B))} FROM signs1),
signs AS (SELECT kind, term, {each(lambda x, b: f'xor({x}, {x} >> 31)')} FROM signs2)"""


SIGNS = _sign_ctes(FE.COMPONENTS // 64)


BODIES = f"bodies AS (SELECT user_id, chunk_id, course_id, chapter_num, {embed_text()} AS text FROM chunks_v)"


def encoded_lists(subs: str = "used") -> str:
    """CTE dense (user_id, q_id, sub_no, chunk_id, rank): cosine lists of the sub-queries under the corpus' TF-IDF projection."""
    return f"""{BODIES}, {grams('chunk', 'bodies', 'user_id, chunk_id')}, {vocabulary('bodies')}, {gram_weights('chunk', 'user_id, chunk_id')}, {SIGNS},
{projected('chunk', 'user_id, chunk_id')}, {grams('sub', subs, 'user_id, q_id, sub_no', 'q')}, {gram_weights('sub', 'user_id, q_id, sub_no')}, {projected('sub', 'user_id, q_id, sub_no')},
dense AS (SELECT * FROM (SELECT user_id, q_id, sub_no, chunk_id, score, row_number() OVER (PARTITION BY user_id, q_id, sub_no ORDER BY score DESC, chunk_id) - 1 AS rank
  FROM (SELECT v.user_id, v.q_id, v.sub_no, c.chunk_id, round(list_cosine_similarity(v.embedding, c.embedding), 4) AS score
    FROM sub_vec v JOIN {subs} u USING (user_id, q_id, sub_no) JOIN chunk_vec c USING (user_id) JOIN bodies k USING (user_id, chunk_id)
    WHERE (u.want_course IS NULL OR u.want_course = k.course_id) AND (u.want_chapter IS NULL OR u.want_chapter = k.chapter_num))) WHERE rank < {V.DENSE_TOP_K})"""


def projected(name: str, key: str) -> str:
    """CTE {name}_vec (key, embedding), not yet of unit length, over {name}_w and SIGNS."""
    sums = ", ".join(f"SUM(CASE WHEN (x{i // 64} >> {i % 64}) & 1 = 1 THEN weight ELSE -weight END)" for i in range(FE.COMPONENTS))
    return f"{name}_vec AS (SELECT {key}, [{sums}] AS embedding FROM {name}_w JOIN signs USING (kind, term) GROUP BY {key})"
