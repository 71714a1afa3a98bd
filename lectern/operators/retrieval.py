"""Hybrid retrieval over many tenants: postings, BM25, blocked cosine, fusion, rerank, refusal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import text as X
from lectern.functions.common import exact_sum, first_row, let, matches, spread, sql_round, top_rows
from lectern.operators.dense import dense_topk
from lectern.operators.features import TextEncoder
from lectern.operators.sparse import block_search, chunk_tokens, corpus_size, document_frequency, token_blocks
from lectern.session import cut_lineage


@dataclass(frozen=True)
class SearchConfig:
    """Stage switches; the defaults are the full search."""

    use_dense: bool = True
    use_sparse: bool = True
    use_rerank: bool = True
    rerank_mode: str = "rank"  # rank | confidence
    use_parent: bool = True
    decompose: bool = True
    title_boost: float = V.TITLE_BOOST
    rrf_k: int = V.RRF_K
    dense_top_k: int = V.DENSE_TOP_K
    sparse_top_k: int = V.SPARSE_TOP_K
    fused_top_k: int = V.FUSED_TOP_K
    final_top_k: int = V.FINAL_TOP_K
    refusal_threshold: float = V.REFUSAL_THRESHOLD


# Each rung adds one stage to the one above it; the last is the shipped configuration.
LADDER = [
    ("dense only", SearchConfig(use_sparse=False, use_rerank=False, use_parent=False, decompose=False, title_boost=0.0)),
    ("sparse only (BM25)", SearchConfig(use_dense=False, use_rerank=False, use_parent=False, decompose=False, title_boost=0.0)),
    ("+ BM25 (RRF)", SearchConfig(use_rerank=False, use_parent=False, decompose=False, title_boost=0.0)),
    ("+ rerank (reorder)", SearchConfig(use_parent=False, decompose=False, title_boost=0.0)),
    ("+ rerank (confidence)", SearchConfig(use_parent=False, rerank_mode="confidence", decompose=False, title_boost=0.0)),
    ("+ parent-child", SearchConfig(decompose=False, title_boost=0.0)),
    ("+ decompose", SearchConfig(title_boost=0.0)),
    ("+ title-boost 0.30 [shipped]", SearchConfig()),
]


# --- sparse index -----------------------------------------------------------------------


def index_text(chunks: DataFrame) -> Column:
    """What is indexed of a chunk: its text behind the context prefix."""
    c = F.col
    return X.embed_text(c("course_id"), c("chapter_num"), c("chapter_title"), c("section"), c("text"))


def index_tokens(chunks: DataFrame) -> DataFrame:
    """(user_id, chunk_id, course_id, chapter_num, tokens) of the indexed text."""
    return chunk_tokens(chunks, ["user_id", "chunk_id", "course_id", "chapter_num"], index_text(chunks))


def postings(tokenised: DataFrame) -> DataFrame:
    """(user_id, token, chunk_id, course_id, chapter_num, dl, tf).

    Length and scope of the chunk ride along, so no join brings them back at query time.
    """
    carried = ["user_id", "chunk_id", "course_id", "chapter_num", F.size("tokens").alias("dl")]
    exploded = tokenised.select(*carried, F.explode("tokens").alias("token"))
    return exploded.groupBy("user_id", "chunk_id", "course_id", "chapter_num", "dl", "token").agg(
        F.count("*").alias("tf")
    )


def bm25_idf(frequency: DataFrame, corpus: DataFrame) -> DataFrame:
    """(user_id, token, df, idf, avgdl); a negative idf becomes a share of the tenant's mean idf."""
    raw = frequency.join(corpus, "user_id").withColumn(
        "raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.groupBy("user_id").agg((exact_sum(F.col("raw")) / F.count("*")).alias("mean"))
    idf = F.when(F.col("raw") < 0, V.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(mean, "user_id").select("user_id", "token", "df", idf.alias("idf"), "avgdl", "n_docs")


@dataclass
class SparseIndex:
    tokens: DataFrame
    blocks: DataFrame
    idf: DataFrame
    corpus: DataFrame


def build_index(chunks: DataFrame, stored: bool = False) -> SparseIndex:
    """Index of a corpus; `stored` writes its tables once for the jobs that read them many times.

    Tokens in order are read by the reranker alone, and are cut again there: as a table they are larger than the texts.
    """
    keep = cut_lineage if stored else lambda df: df
    blocks = keep(token_blocks(chunks, index_text(chunks)))
    corpus = keep(corpus_size(blocks))
    return SparseIndex(index_tokens(chunks), blocks, keep(bm25_idf(document_frequency(blocks), corpus)), corpus)


def query_terms(queries: DataFrame, key: list[str], text: str = "q") -> DataFrame:
    """(key, token, n): terms of each query with how often it repeats them."""
    exploded = queries.select(*key, F.explode(X.tokens(F.col(text))).alias("token"))
    return exploded.groupBy(*key, "token").agg(F.count("*").alias("n"))


def bm25_topk(
    queries: DataFrame, index: SparseIndex, key: list[str], text: str = "q", k: int = V.SPARSE_TOP_K
) -> DataFrame:
    """(key, chunk_id, score, rank): the `k` best chunks of every query among all that share a term with it.

    Columns `want_course` and `want_chapter` of the queries, where present, restrict the chunks scored. Query terms meet the
    idf table; then packs of queries meet blocks of chunks (`sparse.py`), so the rows joined are blocks, not postings.
    """
    wanted = [c for c in ("want_course", "want_chapter") if c in queries.columns]
    terms = query_terms(queries, [*key, *wanted], text).join(index.idf, ["user_id", "token"])
    return block_search(terms, index.blocks, key, k)


# --- vectors ---------------------------------------------------------------------------------

def l2_normalise(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors; a zero vector stays zero."""
    values = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return vectors.withColumn("_norm", safe).withColumn(
        column, F.transform(values, lambda x: x / F.col("_norm"))
    ).drop("_norm")


def encode(texts: DataFrame, encoder, text: str, column: str = "embedding", query_prefix: str = "") -> DataFrame:
    """Encoder hook: `encoder(list[str]) -> 2-d array`, called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = np.asarray(encoder([query_prefix + t for t in batch]), dtype=np.float32)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(norms == 0, 1.0, norms)))

    return texts.withColumn(column, embed(F.col(text)))


# --- fusion ---------------------------------------------------------------------------------


def rrf(lists: DataFrame, key: list[str], k: int = V.RRF_K, limit: int = V.FUSED_TOP_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (key, chunk_id, rank, weight) rows."""
    gain = F.col("weight") / (k + F.col("rank") + 1)
    fused = lists.groupBy(*key, "chunk_id").agg(F.round(exact_sum(gain), 8).alias("rrf_score"))
    return top_rows(fused, key, [F.desc("rrf_score"), F.asc("chunk_id")], limit, "fused_rank")


def first_positions(lists: DataFrame, key: list[str]) -> DataFrame:
    """Rank of each chunk in the first list that holds it: (key, chunk_id, rank)."""
    return lists.groupBy(*key, "chunk_id").agg(F.min_by("rank", "list_no").alias("rank"))


# --- rerank -----------------------------------------------------------------------------------


def rerank_terms(queries: DataFrame, index: SparseIndex, key: list[str], text: str = "q") -> DataFrame:
    """The at most eight most specific content terms of each query, with phrase and idf total.

    (key, phrase, terms array<struct<token, idf>>)
    """
    toks = queries.select(*key, X.tokens(F.col(text)).alias("toks"))
    unique = F.array_distinct("toks")
    content = F.filter(unique, lambda t: ~t.isin(V.FRAMING_WORDS))
    kept = F.when(F.size(content) > 0, content).otherwise(unique)
    terms = toks.select(*key, F.array_join("toks", " ").alias("phrase"), F.posexplode(kept).alias("pos", "token"))
    terms = terms.join(index.idf.select("user_id", "token", "df"), ["user_id", "token"], "left")
    terms = terms.join(index.corpus.select("user_id", "n_docs"), "user_id", "left")
    idf = F.log((F.coalesce("n_docs", F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + 0.5))
    terms = terms.withColumn("idf", F.when(F.coalesce("n_docs", F.lit(0)) == 0, 1.0).otherwise(F.round(idf, 10)))
    best = top_rows(terms, key, [F.desc("idf"), F.asc("pos")], V.RERANK_MAX_TERMS, "term_no")
    return best.groupBy(*key, "phrase").agg(
        F.array_sort(F.collect_list(F.struct("term_no", "token", "idf"))).alias("terms")
    )


def min_window(tokens: Column, wanted: Column) -> Column:
    """Length of the shortest run of `tokens` that holds every element of `wanted` it contains.

    One pass: it keeps the last position of each matched term; at every match the best window ends
    there and starts at the oldest of those positions.
    """
    return let(F.array_intersect(wanted, tokens), lambda matched: _window_of(tokens, matched))


def _window_of(tokens: Column, matched: Column) -> Column:
    places = F.filter(
        F.transform(tokens, lambda t, i: F.struct(F.array_position(matched, t).alias("t"), i.cast("long").alias("i"))),
        lambda p: p["t"] > 0,
    )
    start = F.struct(
        F.transform(matched, lambda _: F.lit(-1).cast("long")).alias("last"), F.lit(None).cast("long").alias("best")
    )

    def step(state: Column, place: Column) -> Column:
        seen = F.transform(state["last"], lambda v, j: F.when(j + 1 == place["t"], place["i"]).otherwise(v))

        def close(last: Column) -> Column:
            oldest = F.array_min(last)
            here = F.when(oldest >= 0, place["i"] - oldest + 1)
            return F.struct(last.alias("last"), F.least(state["best"], here).alias("best"))

        return let(seen, close)

    return F.aggregate(places, start, step, lambda s: s["best"])


def rerank_score(terms: Column, phrase: Column, tokens: Column) -> Column:
    """Coverage, proximity and phrase bonus in [0, 1] of one passage for one query."""
    names = F.transform(terms, lambda t: t["token"])
    return F.when(F.size(tokens) == 0, 0.0).otherwise(
        let(F.array_intersect(names, tokens), lambda matched: _score_matched(terms, phrase, tokens, matched))
    )


def _score_matched(terms: Column, phrase: Column, tokens: Column, matched: Column) -> Column:
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["idf"])
    hit = F.aggregate(
        terms, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(matched, t["token"]), t["idf"]).otherwise(0.0)
    )
    n = F.size(matched)
    proximity = (
        F.when(n > 1, n / F.greatest(_window_of(tokens, matched), n.cast("long")))
        .when(n == 1, V.RERANK_SINGLE_PROXIMITY)
        .otherwise(0.0)
    )
    bonus = F.when((phrase != "") & F.contains(F.array_join(tokens, " "), phrase), V.RERANK_PHRASE_BONUS).otherwise(0.0)

    def blend(s: Column) -> Column:
        return V.RERANK_COVERAGE * s["cov"] + V.RERANK_PROXIMITY * s["cov"] * s["prox"] + s["bonus"]

    parts = F.struct(
        (hit / F.when(total == 0, 1.0).otherwise(total)).alias("cov"), proximity.alias("prox"), bonus.alias("bonus")
    )
    return sql_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), let(parts, blend))), 6)


def lexical_rerank(
    candidates: DataFrame, queries: DataFrame, index: SparseIndex, key: list[str], text: str = "q"
) -> DataFrame:
    """Adds rerank_score to (key, chunk_id, ...) candidates. A query without terms scores 0."""
    terms = rerank_terms(queries, index, key, text)
    texts = index.tokens.select("user_id", "chunk_id", "tokens")
    joined = spread(candidates.join(terms, key, "left"), "user_id", "chunk_id").join(texts, ["user_id", "chunk_id"])
    score = F.coalesce(rerank_score(F.col("terms"), F.col("phrase"), F.col("tokens")), F.lit(0.0))
    return joined.withColumn("rerank_score", score).drop("terms", "phrase", "tokens")


def rerank_hook(candidates: DataFrame, reranker, query: str = "q", text: str = "text") -> DataFrame:
    """Reranker hook: `reranker(list[str], list[str]) -> scores` over Arrow batches of candidates."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.asarray(reranker(list(queries), list(passages)), dtype=float), 0.0, 1.0))

    return candidates.withColumn("rerank_score", score(F.col(query), F.col(text)))


# --- titles, parents ---------------------------------------------------------------------------


def chapter_titles(chunks: DataFrame) -> DataFrame:
    """First non-empty title per chapter: (user_id, course_id, chapter_num, title)."""
    named = chunks.where((F.col("chapter_num") != 0) & (F.col("chapter_title") != ""))
    return named.groupBy("user_id", "course_id", "chapter_num").agg(
        F.min_by("chapter_title", "ordinal").alias("title")
    )


def order_candidates(candidates: DataFrame, key: list[str], config: SearchConfig) -> DataFrame:
    """Final ranks under a rerank policy.

    `candidates` has rrf_score, fused_rank, rerank_score and title_sim. Policy `rank` reorders by the
    reranker, `confidence` and no rerank keep the fused order; the title boost joins either.
    """
    base = F.col("rerank_score") if config.use_rerank and config.rerank_mode == "rank" else F.col("rrf_score")
    ranking = sql_round(base + F.lit(config.title_boost) * F.col("title_sim"), 6)
    out = candidates.withColumn("ranking", ranking)
    return top_rows(out, key, [F.desc("ranking"), F.asc("fused_rank")], config.final_top_k, "final_rank")


def hydrate(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits with the text of their chunk and its parent, of the same tenant only."""
    texts = chunks.select("user_id", "chunk_id", "parent_id", "text")
    parent = parents.select("user_id", "parent_id", F.col("text").alias("parent_text"))
    return hits.join(texts, ["user_id", "chunk_id"]).join(parent, ["user_id", "parent_id"], "left")


# --- refusal ---------------------------------------------------------------------------------------


def question_intent(questions: DataFrame, text: str = "q") -> DataFrame:
    found = questions.withColumn("_intent", X.intent(F.col(text)))
    return found.withColumns({"intent": F.col("_intent.intent"), "phrase": F.col("_intent.phrase")}).drop("_intent")


def intent_gate(questions: DataFrame, courses: DataFrame, text: str = "q") -> DataFrame:
    """Adds intent, phrase, has_link and gate_refused.

    A quantitative question is refused only for a course without a data link; without a course a
    link is assumed.
    """
    link = courses.select("user_id", "course_id", "has_data_link")
    out = question_intent(questions, text).join(link, ["user_id", "course_id"], "left")
    has_link = F.when(F.col("course_id").isNull(), True).otherwise(F.coalesce("has_data_link", F.lit(False)))
    refused = F.col("intent").isin("out_of_scope", "needs_live_data") | (
        (F.col("intent") == "quantitative_request") & ~has_link
    )
    return out.withColumn("has_link", has_link).withColumn("gate_refused", refused).drop("has_data_link")


def highest_chapters(chunks: DataFrame) -> DataFrame:
    """Highest chapter per course, and per tenant in rows whose course is null."""
    numbered = chunks.where(F.col("chapter_num") != 0)
    return numbered.rollup("user_id", "course_id").agg(F.max("chapter_num").alias("highest")).where(
        F.col("user_id").isNotNull()
    )


def chapter_range_check(questions: DataFrame, chunks: DataFrame, text: str = "q") -> DataFrame:
    """Adds beyond_chapter (first chapter named above the corpus, or null) and highest."""
    scope = highest_chapters(chunks).withColumnRenamed("course_id", "scope_course")
    named = questions.withColumn("_mentions", X.chapter_mentions(F.col(text)))
    same = (named.user_id == scope.user_id) & named.course_id.eqNullSafe(scope.scope_course)
    joined = named.join(scope.select(scope.user_id.alias("_user"), "scope_course", "highest"), 
                        (F.col("user_id") == F.col("_user")) & F.col("course_id").eqNullSafe(F.col("scope_course")), "left")
    beyond = F.try_element_at(F.filter("_mentions", lambda n: n > F.col("highest")), F.lit(1))
    return joined.withColumn("beyond_chapter", beyond).drop("_mentions", "_user", "scope_course")


def refusal_decision(confidence: DataFrame, threshold: float = V.REFUSAL_THRESHOLD) -> DataFrame:
    low = F.col("confidence") < threshold
    reason = F.when(
        low,
        F.format_string(
            f"top passage scored %.2f, below the calibrated threshold of {threshold:.2f}", F.col("confidence")
        ),
    ).otherwise("")
    return confidence.withColumn("refused", low).withColumn("reason", reason)


# --- whole search --------------------------------------------------------------------------------------


@dataclass
class DenseIndex:
    """Vectors of the chunks, and how a table of texts gets vectors of the same kind."""

    vectors: DataFrame  # user_id, chunk_id, course_id, chapter_num, embedding
    encode: Callable[[DataFrame, list[str]], DataFrame]  # (texts with key and text, key) -> (key, embedding)


def build_dense_index(chunks: DataFrame) -> DenseIndex:
    """The corpus' own TF-IDF projection: chunks are encoded with their context, further texts under the same vocabulary."""
    c = F.col
    body = X.embed_text(c("course_id"), c("chapter_num"), c("chapter_title"), c("section"), c("text"))
    encoder = TextEncoder.fit(chunks.select("user_id", "chunk_id", body.alias("text")))
    scope = chunks.select("user_id", "chunk_id", "course_id", "chapter_num")
    vectors = encoder.corpus_vectors().join(scope, ["user_id", "chunk_id"])
    return DenseIndex(cut_lineage(vectors), encoder.vectors)


def subquery_rows(questions: DataFrame, config: SearchConfig) -> DataFrame:
    """A row for each sub-query of each question: user_id, q_id, sub_no, q, weight, and the question's scope.

    A question that isn't compound, or all without decomposition, is its own only sub-query of weight 1.
    """
    scope = [c for c in ("want_course", "want_chapter") if c in questions.columns]
    parsed = questions.withColumn("_d", X.decompose(F.col("q")))
    whole = F.array(F.struct(F.col("q").alias("text"), F.lit(1.0).alias("weight"), F.lit("whole").alias("kind")))
    subs = F.when(F.lit(config.decompose) & F.col("_d.is_compound"), F.col("_d.subqueries")).otherwise(whole)
    rows = parsed.select("user_id", "q_id", *scope, F.posexplode(subs).alias("sub_no", "s"))
    return rows.select("user_id", "q_id", "sub_no", *scope, F.col("s.text").alias("q"), "s.weight")


def retrieval_lists(subs: DataFrame, index: SparseIndex, dense: DenseIndex | None, config: SearchConfig) -> DataFrame:
    """(user_id, q_id, sub_no, weight, kind, chunk_id, rank): a sparse and a dense list for each sub-query, in its scope."""
    key = ["user_id", "q_id", "sub_no"]
    weights = subs.select(*key, "weight")
    lists = []
    if config.use_sparse:
        lists.append(bm25_topk(subs, index, key, k=config.sparse_top_k).withColumn("kind", F.lit("sparse")))
    if config.use_dense and dense is not None:
        vectors = dense.encode(subs.select(*key, F.col("q").alias("text")), key)
        asked = vectors.join(subs.drop("q", "weight"), key)
        lists.append(dense_topk(asked, dense.vectors, config.dense_top_k, key).withColumn("kind", F.lit("dense")))
    merged = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return merged.join(weights, key).select(*key, "weight", "kind", "chunk_id", "rank")


def scope_sizes(chunks: DataFrame) -> DataFrame:
    """(s_user, s_course, s_chapter, n_chunks) of every scope that holds chunks; null where a scope has no such limit."""
    sizes = chunks.cube("user_id", "course_id", "chapter_num").agg(F.count("*").alias("n_chunks")).where("user_id IS NOT NULL")
    return sizes.selectExpr("user_id AS s_user", "course_id AS s_course", "chapter_num AS s_chapter", "n_chunks")


def search_batch(
    questions: DataFrame,
    chunks: DataFrame,
    courses: DataFrame,
    parents: DataFrame | None = None,
    dense: DenseIndex | None = None,
    config: SearchConfig | None = None,
    index: SparseIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Search a table of questions (user_id, q_id, q, course_id[, chapter_num]): (ranked passages, verdicts).

    Every sub-query contributes a sparse list and, with a `dense` index, a dense list; both keep to the question's course
    and chapter before any top-k cut, and are fused with the sub-query's weight. Passages carry the rank of their first
    sparse and first dense list, the reranker's score and, with `parents`, the text of their parent. The reranker orders by
    the whole question; confidence reads the concept alone where the question is compound, over the pool in mode `rank` and
    over the returned head in mode `confidence`; without reranking it is 1.

    Verdicts say whether a question is refused and why, the first that holds: nothing loaded in its scope, nothing
    retrieved, a chapter beyond the corpus, an intent the corpus can't serve, a confidence below the threshold.
    """
    config = config or SearchConfig()
    index = index or build_index(chunks)
    key = ["user_id", "q_id"]
    if "chapter_num" not in questions.columns:
        questions = questions.withColumn("chapter_num", F.lit(None).cast(chunks.schema["chapter_num"].dataType))
    asked = questions.select(*key, "q", F.col("course_id").alias("want_course"), F.col("chapter_num").alias("want_chapter"))
    lists = cut_lineage(retrieval_lists(subquery_rows(asked, config), index, dense, config))
    fused = rrf(lists, key, config.rrf_k, config.fused_top_k)

    facts = questions.select(*key, "q", X.decompose(F.col("q")).alias("_d"))
    compound = F.lit(config.decompose) & F.col("_d.is_compound") & (F.col("_d.concept") != "")
    about = F.when(F.lit(config.decompose) & (F.col("_d.concept") != ""), F.col("_d.concept")).otherwise(F.col("q"))
    facts = facts.select(*key, "q", compound.alias("compound"), F.col("_d.concept").alias("concept"), about.alias("about"))
    titles = chunks.select("user_id", "chunk_id", "course_id", "chapter_num", "chapter_title")
    pool = fused.join(titles, ["user_id", "chunk_id"]).join(facts.select(*key, "about", "compound"), key)
    pool = pool.withColumn("title_sim", X.title_similarity(F.col("about"), F.col("chapter_title"))).drop("about")
    if config.use_rerank:
        # both readings of a compound question are scored in one pass, told apart by their role
        roles = facts.select(*key, F.lit(0).alias("role"), "q").unionByName(facts.where("compound").select(*key, F.lit(1).alias("role"), F.col("concept").alias("q")))
        both = pool.join(roles.select(*key, "role"), key)
        scored = cut_lineage(lexical_rerank(both, roles, index, [*key, "role"]))
        pool = scored.where("role = 0").drop("role")
        narrowed = scored.where("role = 1").groupBy(*key).agg(F.max("rerank_score").alias("concept_confidence"))
    else:
        pool = pool.withColumn("rerank_score", F.lit(None).cast("double"))
    ranked = order_candidates(pool, key, config)

    def first(kind: str) -> DataFrame:
        mine = lists.where(F.col("kind") == kind).withColumnRenamed("sub_no", "list_no")
        return first_positions(mine, key).withColumnRenamed("rank", f"{kind}_rank")

    passages = ranked.join(first("sparse"), [*key, "chunk_id"], "left").join(first("dense"), [*key, "chunk_id"], "left")
    if config.use_parent and parents is not None:
        texts = chunks.select("user_id", "chunk_id", "parent_id").join(
            parents.select("user_id", "parent_id", F.col("text").alias("parent_text")), ["user_id", "parent_id"]
        )
        passages = passages.join(texts.drop("parent_id"), ["user_id", "chunk_id"], "left")
    passages = passages.drop("compound", "ranking")

    base = questions.join(lists.select(*key).distinct().withColumn("found", F.lit(True)), key, "left")
    if not config.use_rerank:
        base = base.withColumn("confidence", F.when(F.col("found"), 1.0).otherwise(0.0))
    elif config.rerank_mode == "rank":
        plain = pool.groupBy(*key).agg(F.max("rerank_score").alias("whole_confidence"))
        base = base.join(plain, key, "left").join(narrowed, key, "left")
        base = base.withColumn("confidence", F.coalesce("concept_confidence", "whole_confidence", F.lit(0.0))).drop("whole_confidence", "concept_confidence")
    else:
        head = ranked.groupBy(*key).agg(F.max("rerank_score").alias("head_confidence"))
        base = base.join(head, key, "left").withColumn("confidence", F.coalesce("head_confidence", F.lit(0.0))).drop("head_confidence")
    sizes = scope_sizes(chunks)
    scope = (F.col("user_id") == F.col("s_user")) & F.col("course_id").eqNullSafe(F.col("s_course")) & F.col("chapter_num").eqNullSafe(F.col("s_chapter"))
    base = base.join(sizes, scope, "left").drop("s_user", "s_course", "s_chapter")
    verdicts = chapter_range_check(intent_gate(base, courses), chunks)
    empty, lost = F.col("n_chunks").isNull(), F.col("found").isNull()
    beyond = F.col("beyond_chapter").isNotNull()
    gate = ~empty & ~lost & (F.col("gate_refused") | beyond)
    confidence = F.when(empty | lost | beyond, 0.0).otherwise(F.col("confidence"))
    low = F.format_string(f"top passage scored %.2f, below the calibrated threshold of {config.refusal_threshold:.2f}", "confidence")
    reason = (
        F.when(empty, "no materials loaded")
        .when(lost, "no candidates retrieved")
        .when(beyond, F.format_string("chapter %d is beyond the last chapter, %d", "beyond_chapter", "highest"))
        .when(F.col("gate_refused"), F.concat("intent", F.lit(": "), F.lower("phrase")))
        .when(F.col("confidence") < config.refusal_threshold, low)
        .otherwise("")
    )
    verdicts = verdicts.withColumn("reason", reason).withColumn("gate_refused", gate).withColumn("confidence", confidence)
    verdicts = verdicts.withColumn("refused", F.col("reason") != "")
    return passages, verdicts.select(*key, "course_id", "intent", "beyond_chapter", "confidence", "gate_refused", "refused", "reason")


def ablation_ladder(
    questions: DataFrame, chunks: DataFrame, index: SparseIndex, dense: DenseIndex, ladder: list[tuple[str, SearchConfig]] = LADDER
) -> DataFrame:
    """(config, user_id, q_id, chunk_id, rank, parent_id) of every rung of `ladder` for questions (user_id, q_id, q).

    The configuration is a column: lists of a question as a whole and, where it is compound, of its sub-queries are searched
    once, each list goes to the rungs that read it, and each candidate is reranked once. Depths are those of the first rung.
    `parent_id` is the parent that a rung shows, null in rungs without parents and where `chunks` know none; it moves no rank.
    """
    key, c = ["user_id", "q_id"], F.col
    depths = replace(ladder[0][1], use_sparse=True, use_dense=True)
    parsed = cut_lineage(questions.select(*key, "q", X.decompose(c("q")).alias("_d")))
    plain = parsed.select(*key, F.lit(-1).alias("sub_no"), "q", F.lit(1.0).alias("weight"), F.lit(True).alias("as_whole"), (~c("_d.is_compound")).alias("in_parts"))
    parts = parsed.where("_d.is_compound").select(*key, F.posexplode("_d.subqueries").alias("sub_no", "s"))
    parts = parts.select(*key, "sub_no", c("s.text").alias("q"), "s.weight", F.lit(False).alias("as_whole"), F.lit(True).alias("in_parts"))
    subs = cut_lineage(plain.unionByName(parts))
    lists = retrieval_lists(subs.drop("as_whole", "in_parts"), index, dense, depths)
    lists = lists.join(subs.select(*key, "sub_no", "as_whole", "in_parts"), [*key, "sub_no"])

    fields = ["use_dense", "use_sparse", "use_rerank", "use_parent", "decompose", "rerank_mode", "title_boost"]
    rungs = F.array(*[F.struct(F.lit(name).alias("config"), *[F.lit(getattr(r, f)).alias(f) for f in fields]) for name, r in ladder])
    reads = ((c("kind") == "dense") & c("r.use_dense") | (c("kind") == "sparse") & c("r.use_sparse")) & F.when(c("r.decompose"), c("in_parts")).otherwise(c("as_whole"))
    read = lists.withColumn("r", F.explode(rungs)).where(reads).select(c("r.config").alias("config"), *key, "chunk_id", "rank", "weight")
    fused = cut_lineage(rrf(read, ["config", *key], depths.rrf_k, depths.fused_top_k))

    candidates = fused.select(*key, "chunk_id").distinct()
    about = F.when(c("_d.concept") != "", c("_d.concept")).otherwise(c("q"))
    titles = chunks.select("user_id", "chunk_id", "chapter_title", c("parent_id") if "parent_id" in chunks.columns else F.lit(None).cast("string").alias("parent_id"))
    facts = lexical_rerank(candidates, parsed.select(*key, "q"), index, key).join(parsed, key).join(titles, ["user_id", "chunk_id"])
    likeness = {"whole_sim": X.title_similarity(c("q"), c("chapter_title")), "concept_sim": X.title_similarity(about, c("chapter_title"))}
    facts = facts.withColumns(likeness).select(*key, "chunk_id", "rerank_score", "whole_sim", "concept_sim", "parent_id")

    stage = F.filter(rungs, lambda r: r["config"] == c("config"))[0]
    pool = fused.withColumn("r", stage).join(facts, [*key, "chunk_id"])
    score = F.when(c("r.use_rerank") & (c("r.rerank_mode") == "rank"), c("rerank_score")).otherwise(c("rrf_score"))
    boost = c("r.title_boost") * F.when(c("r.decompose"), c("concept_sim")).otherwise(c("whole_sim"))
    pool = pool.withColumn("ranking", sql_round(score + boost, 6)).withColumn("parent_id", F.when(c("r.use_parent"), c("parent_id")))
    ranked = top_rows(pool, ["config", *key], [F.desc("ranking"), F.asc("fused_rank")], depths.fused_top_k, "final_rank")
    return ranked.select("config", *key, "chunk_id", c("final_rank").alias("rank"), "parent_id")


# --- evidence series ---------------------------------------------------------------------------------------


def series_transform(series: DataFrame) -> DataFrame:
    """Level of percent series, year-over-year percent of everything else.

    `series` has series_id, month (first of month), units and value, once a month in each unit; values are compared within their unit.
    """
    year_ago = F.lag("value", 12).over(Window.partitionBy("series_id", "units").orderBy("month"))
    level = matches(F.col("units"), "percent")
    value = F.when(level, F.col("value")).otherwise(100 * (F.try_divide(F.col("value"), year_ago) - 1))
    return series.withColumn("transform", F.when(level, "level").otherwise("yoy")).withColumn("shown", value)


def evidence_select(proposals: DataFrame, hits: DataFrame, series: DataFrame, per_question: int = 2) -> DataFrame:
    """At most two series per question, one per proposal and never the same twice.

    `proposals`: user_id, q_id, proposal_no, query, eligible. `hits`: query, hit_no, series_id.
    `series`: series_id with at least one value. Queries shaped like an identifier are rejected, and
    so is a query the question already made.
    """
    key = ["user_id", "q_id"]
    usable = proposals.where(F.col("eligible") & (F.col("query") != "") & ~F.col("query").rlike("^[A-Z0-9]{3,20}$"))
    usable = first_row(usable, [*key, "query"], [F.asc("proposal_no")])
    live = hits.join(series.select("series_id").distinct(), "series_id", "left_semi")
    open_hits = usable.join(live, "query").select(*key, "proposal_no", "query", "hit_no", "series_id")
    chosen = None
    for slot in range(per_question):
        pick = first_row(open_hits, key, [F.asc("proposal_no"), F.asc("hit_no"), F.asc("series_id")])
        taken = pick.select(*key, F.col("proposal_no").alias("_no"), F.col("series_id").alias("_id"))
        pick = pick.withColumn("slot", F.lit(slot + 1))
        chosen = pick if chosen is None else chosen.unionByName(pick)
        later = (F.col("proposal_no") > F.col("_no")) & (F.col("series_id") != F.col("_id"))
        open_hits = open_hits.join(taken, key).where(later).drop("_no", "_id")
    return chosen
