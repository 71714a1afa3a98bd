"""Small fixtures against brute force; nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import importlib.util
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate
from lectern.llm import queries as llm
from lectern.llm.decontaminate import contaminated, drop_contaminated
from lectern.llm.embeddings import dedup_embeddings
from lectern.llm.jaccard import similar_components
from lectern.llm.langid import identify, keep_identified
from lectern.llm.mixing import mix_sources
from lectern.llm.pii import pseudonymise
from lectern.llm.stages import one_per_group, without_personal_numbers
from lectern.llm.url_filter import judge_urls

_spec = importlib.util.spec_from_file_location("check", os.path.join(os.path.dirname(__file__), "..", "..", "scripts", "check.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _row string"


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t) if t is not None else None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


def brute_components(texts, words, num, den):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    component = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b) and component[i] != component[j]:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    return [(i, len(s), component[i]) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(300)}"
    out = [" ".join(word() for _ in range(rng.integers(1, 60))) for _ in range(15)]
    for base in list(out[:8]):  # chains of near copies: a word more, a word changed
        parts = base.split()
        out += [base.upper(), base + " more", " ".join([*parts[:-1], "other"]), base + " more again"]
    return [*out, None, "", " \t\n", "one", "One", "z" * 50_000, " ".join(f"long{i}" for i in range(20_000))]


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, texts, words, num):
    got = similar_components(documents(spark, texts), words=words, num=num).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts, words, num, 100)


def test_stage_keeps_one_of_each_group(spark, texts):
    docs = documents(spark, texts)
    repeated = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")))
    kept = one_per_group(repeated)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [i for i, _, c in brute_components(texts, 5, 80, 100) if i == c]
    assert kept.where("doc_id IS NULL").count() == 2
    assert one_per_group(docs.limit(0)).count() == 0


def test_decontamination_stage_drops_what_the_search_finds(spark):
    item = "A train leaves the station at noon and travels ninety miles north before the bridge. How far is the bridge? Ninety miles from the station."
    filler = " ".join(f"plain{i}" for i in range(400))
    texts = [item, f"{filler} {item} {filler}", filler, None, "", "A train leaves the station.", item.upper()]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id IN (0, 2)").withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(docs, items).collect()} == {0, 1, 6, None}
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [2, 3, 4, 5, None]
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert drop_contaminated(docs.limit(0), items).count() == 0


def test_language_stage_keeps_what_is_identified(spark):
    english, german = "the house stands near the river and the people walk there", "das Haus steht nahe am Fluss und die Leute gehen dort hin"
    texts = [english, german] * 6 + [None, "", "123 456", english, german, english]
    langs = ["en", "de"] * 6 + [None] * 6
    docs = documents(spark, texts, langs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs).collect()}
    assert [got[i][0] for i in range(12, 18)] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = keep_identified(docs, 0.5)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 15, 16, 17]
    assert keep_identified(docs.limit(0), 0.5, docs).count() == 0
    assert keep_identified(docs, 0.5, docs.limit(0)).count() == 0


def luhn(number):
    values = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def test_pseudonyms_keep_format_links_and_order_of_text(spark):
    card, mail = "4111 1111 1111 1111", "anna.smith@example.com"
    texts = [f"Pay {card} now, write {mail}.", f"{mail} again", "Born 1980-02-29, seen 29.02.1980", "4111 1111 1111 1112", None, "", "x" * 100_000]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in pseudonymise(docs).collect()}
    new_card, new_mail = rows[0]["text"][4:23], rows[0]["text"][35:-1]
    assert new_card != card and luhn(new_card) and [c.isdigit() for c in new_card] == [c.isdigit() for c in card]
    assert new_mail != mail and rows[1]["text"] == f"{new_mail} again" and len(new_mail) == len(mail)
    born, seen = rows[2]["text"][5:15], rows[2]["text"][-10:]
    assert born != "1980-02-29" and seen == ".".join(reversed(born.split("-")))
    assert rows[3]["text"] == texts[3] and rows[4]["text"] is None and rows[5]["text"] == "" and rows[6]["text"] == texts[6]
    stage = without_personal_numbers(docs)
    assert stage.columns == docs.columns and stage.where("n_chars <> length(text)").count() == 0
    assert pseudonymise(docs.limit(0)).count() == 0


def test_pseudonyms_are_found_behind_other_numbers(spark):
    card, bare, account = "4111 1111 1111 1111", "4785380592391139", "DE89 3704 0044 0532 0130 00"
    texts = [
        f"Pay {card} now", f"in 2020 {card}", f"+1 {card}", f"{card} {card} 7", f"item 7 {bare}", bare, account, account.replace(" ", ""), f"{account} 2020",
        "25/12/1990", "25.12.1990", f"{card} 25.12.1990", "1 2 3 4 555-234-4567", "555-234-4567", "4111 1111 1111 1112",
        "ES91 2100 0418 4502 0005 1332 " + card, f"{bare} a1@example.org",
    ]
    rows = {r["doc_id"]: r for r in pseudonymise(documents(spark, texts)).collect()}
    got = [rows[i]["text"] for i in range(len(texts))]
    new, new_bare, new_account = got[0][4:23], got[5], got[6]
    assert new != card and luhn(new) and new_bare != bare and luhn(new_bare)
    assert got[1:5] == [f"in 2020 {new}", f"+1 {new}", f"{new} {new} 7", f"item 7 {new_bare}"] and rows[3]["n_pseudonyms"] == 2
    assert new_account != account and [len(g) for g in new_account.split(" ")] == [4, 4, 4, 4, 4, 2]
    assert got[7] == new_account.replace(" ", "") and got[8] == f"{new_account} 2020"
    assert got[9] != texts[9] and got[9] == got[10].replace(".", "/") and got[11] == f"{new} {got[10]}"
    assert got[12] == f"1 2 3 4 {got[13]}" and got[13] != texts[13] and got[14] == texts[14]
    assert got[15].endswith(new) and got[15][:29] != texts[15][:29] and got[16].startswith(f"{new_bare} ") and rows[16]["n_pseudonyms"] == 2


def test_pseudonyms_are_a_permutation(spark):
    numbers = spark.range(100, 900).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-12-3456")).alias("text"))
    numbers = numbers.where("doc_id <> 666")
    assert pseudonymise(numbers).select("text").distinct().count() == numbers.count()


def test_mixing_meets_weights(spark):
    rows = [(i, "a b c d", "big" if i % 10 else "small") for i in range(1000)] + [(2000, None, None), (2001, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mix_sources(docs)
    tokens = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert set(tokens) == {"big", "small"} and sum(tokens.values()) <= 4000
    share = np.array(list(tokens.values())) / sum(tokens.values())
    assert -(share * np.log(share)).sum() / np.log(2) >= 0.96 or tokens["small"] >= 3.9 * 400
    assert drawn.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    assert drawn.agg(F.max("epoch")).first()[0] <= 4
    assert mix_sources(docs.limit(0)).count() == 0


def near_vectors(dim):
    rng = np.random.default_rng(3)
    return [v + rng.normal(scale=s, size=dim) for v in rng.normal(size=(12, dim)) for s in (0.0, 0.1, 0.3, 0.5)]


def all_links(vectors):
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    return links


def deduplicated(spark, vectors, more=(), **options):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + list(more)
    return {r["vec_id"]: r for r in dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options).collect()}


def test_embeddings_with_the_lossless_margin_equal_brute_force(spark):
    vectors = near_vectors(16)
    got = deduplicated(spark, vectors, [(90, None), (91, [0.0] * 16), (92, [float("nan")] * 16), (93, [None] + [1.0] * 15)], margin=0.2237)
    links = all_links(vectors)
    component = list(range(len(vectors)))
    for _ in component:
        component = [min([component[i], *[component[j] for j in np.flatnonzero(links[i])]]) for i in range(len(component))]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(vectors))] == [(int(links[i].sum()), component[i]) for i in range(len(vectors))]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (90, 91, 92, 93))


def test_embeddings_with_the_default_margin_find_nine_links_in_ten(spark):
    vectors = near_vectors(64)
    got, links = deduplicated(spark, vectors), all_links(vectors).sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()


def test_embeddings_by_default_lose_no_link_at_a_boundary(spark):
    rng, pairs = np.random.default_rng(5), []
    for v in rng.normal(size=(150, 8)):
        u = rng.normal(size=8)
        v, u = v / np.linalg.norm(v), u - (u @ v) * v / (v @ v)
        pairs += [v, 0.901 * v + np.sqrt(1 - 0.901**2) * u / np.linalg.norm(u)]
    links = all_links(pairs).sum(1)
    got = deduplicated(spark, pairs, per_cell=20, block=8)
    assert [got[i]["n_links"] for i in range(len(pairs))] == list(links)
    short = deduplicated(spark, pairs, per_cell=20, block=8, margin=0.1)
    assert sum(r["n_links"] for r in short.values()) < links.sum()


def test_url_rules_and_edges(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/1", "http://x.com/fr/", "http://x.com/de/a", "ftp://h?q/"]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/1", "example.org/en/1"),
        ("x.com", "/fr/", "com/fr/"), ("x.com", "/de/a", "com/de/"), ("h", "", None)]
    assert [r["verdict"] for r in rows] == ["allow"] * 3 + ["block", "block", "allow", "block", "allow"]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, folder, name):
    verdict = check.compare(llm.QUERIES[name](spark, folder), check.connect(folder), llm.ORACLES[name])
    assert verdict.startswith("ok") and "types" not in verdict, verdict


def test_decontamination_memory_does_not_follow_the_batch(spark):
    random = np.random.default_rng(1)
    said = [" ".join(f"w{w}" for w in random.integers(0, 5000, 20)) for _ in range(200)]
    items = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    (index,) = decontaminate.indexes(items, decontaminate.THRESHOLD)
    texts = [" ".join(f"w{w}" for w in random.integers(0, 5000, 500)) for _ in range(2000)]
    texts[7] += " " + said[3]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        kept = sum(b.num_rows for b in decontaminate.clean_rows([batch], "text", index, decontaminate.THRESHOLD))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept == 1999 and peak < 50e6
