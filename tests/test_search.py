"""Scoped dense search, features and hybrid search against brute force."""

import re
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, features
from lectern.operators import retrieval as R


def clustered(n, dim, seed, clusters=8, noise=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(clusters, size=n)] + noise * rng.normal(size=(n, dim))


def brute(vectors, queries, k):
    out = {}
    for user, q, course, chapter, e in queries:
        if not np.any(e):
            continue
        scored = [
            (-round(float(np.dot(e, v) / (np.linalg.norm(e) * (np.linalg.norm(v) or 1))), 4) + 0.0, i)
            for u, i, c, h, v in vectors
            if u == user and course in (None, c) and chapter in (None, h)
        ]
        out[(user, q)] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_dense_search_equals_brute_force_in_every_scope(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK_FLOATS", block)
    rows = clustered(400, 6, 1)
    vectors = [(f"u{i % 2}", i, ["a", "b", None][i % 3], i % 4, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors += [("u0", 900, "a", 1, [0.0] * 6), ("u0", 901, "a", 1, vectors[0][4])]
    queries = [(f"u{i % 2}", i, [None, "a", "b", "none"][i % 4], [None, 1, None, 3, 9][i % 5], [float(x) for x in v]) for i, v in enumerate(clustered(60, 6, 1)[:60])]
    queries += [("u0", 700, None, None, [0.0] * 6), ("u9", 701, None, None, [1.0] * 6)]
    table = spark.createDataFrame(vectors, "user_id string, chunk_id long, course_id string, chapter_num int, embedding array<double>")
    table = table.unionByName(table.limit(1).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("chunk_id", F.lit(999).cast("long")))
    asked = spark.createDataFrame(queries, "user_id string, q_id long, want_course string, want_chapter int, embedding array<double>")
    got: dict = {}
    for r in R.dense_topk(asked, table, k=7).orderBy("rank").collect():
        got.setdefault((r.user_id, r.q_id), []).append((r.chunk_id, r.score))
    want = {key: found for key, found in brute(vectors, queries, 7).items() if found}
    assert got == want


def test_far_blocks_are_skipped():
    rows = clustered(4000, 16, 3, clusters=20, noise=0.02)
    unit = dense.unit_rows(rows)
    blocks = [b for b in dense.near_blocks(unit, 50)]
    assert sorted(np.concatenate(blocks)) == list(range(4000)) and max(map(len, blocks)) <= 50
    best = dense.Best("u", np.arange(10)[:, None], unit[:10], 20)
    frame = []
    for b in blocks:
        centre = unit[b].mean(axis=0)
        radius = float(np.linalg.norm(unit[b] - centre, axis=1).max())
        frame.append(("u", 16, best.keys.tobytes(), best.unit.tobytes(), b.astype(np.int64).tobytes(), unit[b].tobytes(), centre.tobytes(), radius))
    columns = ["user_id", "dim", "q_keys", "q_vectors", "b_ids", "b_vectors", "centre", "radius"]
    found = pd.concat(dense.search_pairs([pd.DataFrame(frame, columns=columns)], ["user_id", "q_id"], 20))
    scores = np.round(unit[:10] @ unit.T, 4)
    for q in range(10):
        want = sorted(zip(-scores[q], range(4000)))[:20]
        assert list(found[found.q_id == q].chunk_id) == [i for _, i in want]
    for row in sorted(frame, key=lambda r: -(best.unit @ np.frombuffer(r[6])).max() - r[7]):
        ids = np.frombuffer(row[4], np.int64)
        best.meet(ids, np.frombuffer(row[5]).reshape(len(ids), -1), np.frombuffer(row[6]), row[7])
    assert best.skipped > 3 * best.met


def test_most_frequent_cuts_inside_a_tie(spark):
    rows = [("u", "char", f"t{i:02d}", 1, 9 - i // 4) for i in range(30)] + [("v", "char", "only", 1, 1)]
    stats = spark.createDataFrame(rows, "user_id string, kind string, term string, df long, total long")
    for most in (1, 4, 6, 8, 30, 99):
        got = {r.term for r in features.most_frequent(stats, most).where("user_id = 'u'").collect()}
        assert got == {r[2] for r in sorted(rows[:30], key=lambda r: (-r[4], r[2]))[:most]}
    assert features.most_frequent(stats, 3).where("user_id = 'v'").count() == 1


CHUNKS = "user_id string, chunk_id long, course_id string, source_id string, chapter_num int, chapter_title string, section string, ordinal long, parent_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [
        "budget constraint shows what a consumer can afford at given prices",
        "demand curves slope downward because of substitution",
        "elasticities measure responsiveness of quantities",
        "monopolists choose output where marginal revenue meets cost",
        "photosynthesis turns light into sugar inside chloroplasts",
        "mitosis divides a nucleus in four phases",
    ]
    rows = [("u", i, "eco" if i < 4 else "bio", "s", i % 3 + 1, ["Budget Constraint", "Demand", "Elasticity"][i % 3], "", i, i // 2, x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNKS)


def searched(spark, corpus, questions, config=None, dense_index=True):
    asked = spark.createDataFrame([("u", i, *q) for i, q in enumerate(questions)], "user_id string, q_id long, q string, course_id string, chapter_num int")
    courses = spark.createDataFrame([("u", "eco", True), ("u", "bio", False)], "user_id string, course_id string, has_data_link boolean")
    parents = corpus.groupBy("user_id", "parent_id").agg(F.concat_ws(" | ", F.sort_array(F.collect_list("text"))).alias("text"))
    index = R.build_dense_index(corpus) if dense_index else None
    passages, verdicts = R.search_batch(asked, corpus, courses, parents, index, config)
    found: dict = {}
    for r in passages.orderBy("final_rank").collect():
        found.setdefault(r.q_id, []).append(r)
    return found, {r.q_id: r for r in verdicts.collect()}


def test_passages_that_only_the_dense_search_finds_appear(spark, corpus):
    # no whole word in common: "monopoly" and "elasticity" share pieces only with the texts
    question = [("monopolistic chloroplastic elasticize", None, None)]
    found, _ = searched(spark, corpus, question)
    dense_only = [r for r in found[0] if r.sparse_rank is None]
    assert {2, 3, 4} <= {r.chunk_id for r in dense_only} and all(r.dense_rank is not None for r in dense_only)
    assert all(r.parent_text for r in found[0])
    sparse, _ = searched(spark, corpus, question, dense_index=False)
    assert 0 not in sparse


def test_search_keeps_to_its_scope_and_says_why_it_refuses(spark, corpus):
    questions = [
        ("budget constraint", "eco", None), ("budget constraint", "eco", 1), ("budget constraint", "law", None), ("budget constraint", "bio", 9),
        ("summarise chapter 40", "eco", None), ("What grade did I get for demand", "eco", None), ("Show me the trend in mitosis", "bio", None),
        ("zebra crossing violin", "eco", None), ("", "eco", None), ("budget constraint", None, None),
    ]
    found, verdicts = searched(spark, corpus, questions)
    assert {r.chunk_id for r in found[0]} <= {0, 1, 2, 3} and [r.chunk_id for r in found[0]][0] == 0
    assert {r.chunk_id for r in found[1]} <= {0, 3}
    assert [verdicts[i].reason for i in (2, 3)] == ["no materials loaded"] * 2 and 2 not in found
    assert verdicts[4].reason == "chapter 40 is beyond the last chapter, 3" and verdicts[4].confidence == 0 and verdicts[4].gate_refused
    assert verdicts[5].reason.startswith("out_of_scope: ") and verdicts[6].reason.startswith("quantitative_request: ")
    assert verdicts[7].refused and not verdicts[7].gate_refused
    assert verdicts[8].reason == "no candidates retrieved"
    assert not verdicts[0].refused and verdicts[0].reason == "" and not verdicts[9].refused


def test_confidence_reads_the_head_in_its_own_mode(spark, corpus):
    question = [("What is the budget constraint? Give me an example and explain it", "eco", None)]
    _, plain = searched(spark, corpus, question)
    _, head = searched(spark, corpus, question, R.SearchConfig(rerank_mode="confidence"))
    _, none = searched(spark, corpus, question, R.SearchConfig(use_rerank=False))
    assert plain[0].confidence > head[0].confidence > 0 and none[0].confidence == 1.0


def test_latent_vectors_agree_with_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    topics = [[f"{t}word{i}" for i in range(30)] for t in ("alpha", "beta", "gamma", "delta")]
    texts = [" ".join(rng.choice(topics[i % 4], 25)) for i in range(80)]
    docs = spark.createDataFrame([("u", i, x) for i, x in enumerate(texts)] + [("one", 0, "single text here"), ("w", 0, "")], "user_id string, chunk_id long, text string")
    fitted = features.LatentEncoder.fit(docs, 6, 4096)
    weights: dict = {}
    for r in fitted.encoder.corpus_weights().where("user_id = 'u'").collect():
        weights.setdefault(r.chunk_id, {}).update({(r.kind, t["term"]): t["weight"] for t in r.terms})
    terms = {t: n for n, t in enumerate(sorted({t for w in weights.values() for t in w}))}
    matrix = np.zeros((80, len(terms)))
    for i, w in weights.items():
        for t, value in w.items():
            matrix[i, terms[t]] = value
    left, singular, _ = np.linalg.svd(matrix, full_matrices=False)
    want = left[:, :6] * singular[:6]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    vectors = {(r.user_id, r.chunk_id): np.array(r.embedding) for r in fitted.corpus_vectors().collect()}
    got = np.stack([vectors["u", i] for i in range(80)])
    basis = {r.user_id: r for r in fitted.basis.collect()}
    assert got.shape == (80, 6) and basis["u"]["rank"] == 6 and basis["one"]["rank"] == 0 and ("w", 0) not in vectors
    np.testing.assert_allclose(basis["u"]["values"][:4], singular[:4], rtol=0.05)
    # the four topics: the leading four directions span the same subspace
    ours = np.linalg.qr(got * 1.0)[0]
    overlap = np.linalg.svd(ours.T @ left[:, :4])[1]
    assert overlap.min() > 0.95
    assert np.abs(got @ got.T - want @ want.T).max() < 0.35 and np.abs(got @ got.T - want @ want.T).mean() < 0.05
    # further texts land beside those of their topic, and a text of the corpus on itself
    asked = spark.createDataFrame([("u", 1, texts[1]), ("u", 2, " ".join(topics[2][:5])), ("one", 3, "single text here")], "user_id string, q_id long, text string")
    found = {(r.user_id, r.q_id): np.array(r.embedding) for r in fitted.encode(asked, ["user_id", "q_id"]).collect()}
    assert found["u", 1] @ got[1] == pytest.approx(1) and int((got @ found["u", 2]).argmax()) % 4 == 2
    assert found["one", 3] @ vectors["one", 0] == pytest.approx(1)
    assert fitted.encode(asked.limit(0), ["user_id", "q_id"]).count() == 0


def test_rungs_of_the_ladder_equal_searches_of_their_own(spark, corpus):
    questions = [
        ("budget constraint prices", None, None), ("What is the budget constraint? Give me an example", None, None),
        ("How do demand curves slope? How does it play into the real world?", None, None), ("mitosis phases and light", None, None), ("zebra", None, None), ("", None, None),
    ]
    asked = spark.createDataFrame([("u", i, q[0]) for i, q in enumerate(questions)], "user_id string, q_id long, q string")
    got: dict = {}
    for r in R.ablation_ladder(asked, corpus, R.build_index(corpus), R.build_dense_index(corpus)).orderBy("rank").collect():
        got.setdefault(r.config, {}).setdefault(r.q_id, []).append(r)
    assert set(got) == {name for name, _ in R.LADDER}
    for name, config in R.LADDER:
        assert all((r.parent_id is not None) == config.use_parent for rows in got[name].values() for r in rows)
    for name, config in [R.LADDER[i] for i in (0, 4, 6, 7)]:
        want, _ = searched(spark, corpus, questions, replace(config, final_top_k=config.fused_top_k))
        assert {q: [r.chunk_id for r in rows] for q, rows in got[name].items()} == {q: [r.chunk_id for r in rows] for q, rows in want.items()}, name


def test_bm25_lists_equal_sums_over_all_postings_and_never_meet_them_as_rows(spark, monkeypatch):
    from pyspark.sql import Window

    from lectern.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_CHUNKS", 7)
    monkeypatch.setattr(sparse, "DENSE_TERMS", 3)
    monkeypatch.setattr(sparse, "STEP_POSTINGS", 5)
    rng = np.random.default_rng(11)
    words = ["the", "common", "prices-rose", "v1.2", *[f"w{i}ies" for i in range(40)]]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=(w := np.arange(len(words), 0, -1) ** 2.0) / w.sum())) for _ in range(120)] + [None, ""]
    rows = [(f"u{i % 2}", i, ["a", "b", None][i % 3], "s", i % 4, "T", "", i, i, x) for i, x in enumerate([*texts, *texts[:9]])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(f"u{i % 3}", i, [None, "a", "x"][i % 3], [None, 2][i % 2], " ".join(rng.choice(words, 9))) for i in range(40)] + [("u0", 99, None, None, None)]
    questions = spark.createDataFrame(asked, "user_id string, q_id long, want_course string, want_chapter int, q string")
    key, c, index = ["user_id", "q_id"], F.col, R.build_index(chunks)
    post = R.postings(R.index_tokens(chunks))
    assert {(r.user_id, r.token): r.df for r in post.groupBy("user_id", "token").agg(F.count("*").alias("df")).collect()} == {(r.user_id, r.token): r.df for r in index.idf.collect()}
    terms = R.query_terms(questions, [*key, "want_course", "want_chapter"]).join(index.idf, ["user_id", "token"])
    hits = terms.join(post, ["user_id", "token"]).where("(want_course IS NULL OR want_course = course_id) AND (want_chapter IS NULL OR want_chapter = chapter_num)")
    gain = c("n") * c("idf") * (c("tf") * 2.5) / (c("tf") + 1.5 * (0.25 + 0.75 * c("dl") / c("avgdl")))
    scores = hits.groupBy(*key, "chunk_id").agg(F.sum(gain.cast("decimal(38,12)")).cast("double").alias("raw")).where("raw > 0")
    best = scores.select(*key, "chunk_id", F.round("raw", 4).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "chunk_id")) - 1)
    want = sorted(tuple(r) for r in best.where("rank < 6").collect())
    found = R.bm25_topk(questions, index, key, k=6)
    assert sorted(tuple(r) for r in found.select(*key, "chunk_id", "score", "rank").collect()) == want and len(want) > 50
    # a common term used to make a row of each question and each chunk that holds it
    assert "tf" not in found._jdf.queryExecution().analyzed().toString().replace("tfs", "")
    assert R.bm25_topk(questions.limit(0), index, key).count() == 0 and R.bm25_topk(questions, R.build_index(chunks.limit(0)), key).count() == 0


def test_projection_of_lists_equals_that_of_weights_in_one_shuffle_less(spark):
    docs = spark.createDataFrame([("u", i, x) for i, x in enumerate(["one budget line", "demand curves slope", "one demand line", ""])] + [("v", 9, "alone")], "user_id string, chunk_id long, text string")
    fitted, key = features.TextEncoder.fit(docs), ["user_id", "chunk_id"]
    want = {(r.user_id, r.chunk_id): r.embedding for r in features.project(fitted.corpus_weights(), key, 64).collect()}
    found = fitted.corpus_vectors(64)
    got = {(r.user_id, r.chunk_id): r.embedding for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 4
    for name, vector in got.items():
        np.testing.assert_allclose(vector, want[name], atol=1e-12)
    aggregates = [x._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") for x in (found, features.project(fitted.corpus_weights(), key, 64))]
    assert aggregates == [1, 2]


def test_a_term_is_stored_once_a_block_and_blocks_do_not_change_weights(spark):
    texts = [" ".join(f"word{(i * j) % 7} line" for j in range(1, 6)) for i in range(130)] + ["", "!"]
    docs = spark.createDataFrame([(u, i, x) for i, x in enumerate(texts) for u in "uv"] + [(None, 0, "lost words")], "user_id string, chunk_id long, text string").coalesce(1)
    fitted, key = features.TextEncoder.fit(docs), ["user_id", "chunk_id"]
    stored = fitted.corpus.where("user_id = 'u' AND term IS NOT NULL")
    assert stored.count() == stored.select("kind", "term").distinct().count() > 20
    small = features.cut_lineage(features.gram_blocks(docs, key, 100))
    assert small.where("user_id = 'u'").select("block").distinct().count() > 3

    def weights(blocks):
        return {(r.user_id, r.chunk_id, r.kind, t.term): (round(t.weight, 9), t.code) for r in features.weigh(blocks, fitted.vocabulary, key).collect() for t in r.terms}

    assert weights(small) == weights(fitted.corpus) and len(weights(small)) > 1000


def test_features_of_a_block_equal_those_counted_text_by_text(spark):
    """A text of blank lines has no features; letters may be of any alphabet, and pieces and pairs repeat within a text."""
    texts = ["aaaaa aaaaa aaaaa", "\n", "été ba\u0000na\u0000 𝒳𝒳𝒳y", "budget line budget line", "字典の文字 a", "-"]
    docs = spark.createDataFrame([("u", i, x) for i, x in enumerate(texts)], "user_id string, chunk_id long, text string").coalesce(1)
    want = Counter()
    for i, text in enumerate(texts):
        words = re.findall(r"\w{2,}", text.replace("é", "e"))
        want.update((i, "word", term) for term in [*words, *map(" ".join, zip(words, words[1:]))])
        want.update((i, "char", f" {w} "[at : at + k]) for w in re.split(r"\s+", text) if w for k in (3, 4, 5) for at in range(len(w) + 3 - k))
    blocks = features.gram_blocks(docs, ["user_id", "chunk_id"]).collect()
    terms = {r.place: (r.kind, r.term) for r in blocks if r.place is not None}
    found = Counter()
    for r in blocks:
        if r.places is not None and r.n:
            places, counts = (features._unpacked(bytes(x), r.n) for x in (r.places, r.counts))
            found.update({(r.chunk_id, *terms[p]): int(n) for p, n in zip(np.cumsum(places), counts)})
    assert found == want and len({x[1:] for x in want}) == len(terms)
    for r in (r for r in blocks if r.place is not None):
        mine = [n for (_, kind, term), n in want.items() if (kind, term) == (r.kind, r.term)]
        assert (r.df, r.total) == (len(mine), sum(mine))
    assert {r.chunk_id for r in features.tfidf_weights(docs).collect()} == {0, 2, 3, 4, 5}


def test_signs_of_a_text_are_added_up_without_being_written_out():
    rng = np.random.default_rng(3)
    codes, values, word = rng.integers(-(2**63), 2**63, 4000), rng.random(4000), rng.random(4000) < 0.3
    tracemalloc.start()
    found = features._turned(word, values, codes, 1000, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    signs = np.unpackbits(features._sign_bytes(codes, 1000), axis=1, bitorder="little")[:, :1000] * 2.0 - 1.0
    unit = values / np.where(word, np.linalg.norm(values[word]), np.linalg.norm(values[~word]))
    np.testing.assert_allclose(found, unit @ signs / np.sqrt(1000), atol=1e-12)
    assert peak < signs.nbytes / 2


def test_a_tenant_is_searched_in_more_than_one_task(spark):
    rows = spark.createDataFrame([("u", i, [float(x) for x in v]) for i, v in enumerate(clustered(400, 70, 1))], "user_id string, chunk_id long, embedding array<double>")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    packs, blocks = dense.query_packs(rows.withColumnRenamed("chunk_id", "q_id"), ["user_id", "q_id"]), dense.vector_blocks(rows.coalesce(1))
    tasks = dense.in_scope(packs, blocks).select(F.spark_partition_id().alias("task"), "b_ids", "q_keys")
    found = tasks.collect()
    pairs = packs.count() * blocks.count()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len({r.task for r in found}) > 1 and len(found) == len({(bytes(r.b_ids), bytes(r.q_keys)) for r in found}) == pairs
