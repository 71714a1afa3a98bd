"""Benchmark decontamination: an inverted index of test items, searched by every passage, overlaps verified."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import pieces, prepare, store
from lectern.llm.wordhash import SIGNS, rolling, short_shingle, word_hashes

K1, B = 1.2, 0.75
#: Retrieved is an item of whose own score a passage reaches this share.
THRESHOLD = 0.4
SHINGLE = 5
#: Share of shingles from which question or whole item overlap, and share of the answer's words.
QUESTION_SHARE, ANSWER_SHARE = 0.8, 0.5
#: Items in a block of a posting list; the block keeps the largest impact in it.
BLOCK = 8
#: Items of one index: it is sent to every task, so more items are searched for in several passes.
INDEX_ITEMS = 20_000
#: Cells of the (passage, block) and (passage, item) tables that a task holds at once.
CELLS = 2_000_000
#: Bytes of text that a task searches at once: a word takes some 300 bytes of arrays, and every core has a task.
SLICE = 1 << 19
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def folded(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def hashed(text: str) -> np.ndarray:
    return word_hashes(folded(pa.array([text])), SIGNS)[0]


def shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(rolling(hashes, SHINGLE)) if len(hashes) >= SHINGLE else short_shingle(hashes, SHINGLE)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer if others precede it."""
    parts = [p for p in SENTENCE.split(text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def parsed_items(items: DataFrame) -> DataFrame:
    """Terms and shingles of each item that has a word."""
    schema = "item_id long, length long, terms array<long>, counts array<long>, whole array<long>, question array<long>, answer array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = hashed(text or "")
                if not len(words):
                    continue
                terms, counts = np.unique(words.view(np.int64), return_counts=True)
                question, answer = map(hashed, question_and_answer(text))
                out.append((item, len(words), terms, counts, shingles(words), shingles(question), np.unique(answer.view(np.int64))))
            if out:
                columns = list(zip(*out))
                lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *lists], names)

    return items.mapInArrow(rows, schema)


def impacts(parsed: DataFrame) -> DataFrame:
    """BM25 weight of each (item, term), as a share of the item's own score."""
    n, mean = parsed.agg(F.count("*"), F.avg("length")).first()
    rows = parsed.select("item_id", "length", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    rows = rows.select("item_id", "length", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    spread = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1))))
    rows = rows.join(spread, "term").select("item_id", "length", "term", weight.alias("w"))
    own = rows.groupBy("item_id", "length").agg(F.sum("w").alias("own"))
    return rows.join(own, ["item_id", "length"]).select("item_id", "term", (F.col("w") / F.col("own")).alias("impact"))


@dataclass
class Index:
    """Posting lists in CSR form, their blocks with the largest impact, and the terms without which no item is reached."""

    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    most: np.ndarray
    needed: np.ndarray
    spare: float
    names: np.ndarray
    words: int
    parts: list
    maybe: np.ndarray

    @property
    def n_blocks(self) -> int:
        return len(self.names) // BLOCK + 1


def build_index(parsed, postings, threshold: float) -> Index:
    """The index of some items from their parsed rows and impacts (pandas)."""
    names = parsed["item_id"].to_numpy()
    number = {item: k for k, item in enumerate(names)}
    postings = postings.assign(k=[number[i] for i in postings["item_id"]]).sort_values(["term", "k"])
    terms, starts = np.unique(postings["term"].to_numpy(np.int64), return_index=True)
    starts = np.append(starts, len(postings))
    items, weights = postings["k"].to_numpy(np.int64), postings["impact"].to_numpy()
    row_term = np.repeat(np.arange(len(terms)), np.diff(starts))
    key = row_term * (len(names) // BLOCK + 1) + items // BLOCK
    cells, place = np.unique(key, return_index=True)
    block_max = np.maximum.reduceat(weights, place) if len(place) else weights
    block_term = cells // (len(names) // BLOCK + 1)
    most = np.maximum.reduceat(weights, starts[:-1]) if len(terms) else weights
    # terms that together never make up half the threshold of any item: no item is reached by them alone
    spare, needed = np.zeros(len(names)), np.ones(len(terms), bool)
    for t in np.argsort(-np.diff(starts), kind="stable"):
        mine = slice(starts[t], starts[t + 1])
        if starts[t + 1] - starts[t] < 2:
            break
        if (spare[items[mine]] + weights[mine]).max() <= threshold / 2:
            spare[items[mine]] += weights[mine]
            needed[t] = False
    parts = [tuple(np.asarray(r[c], np.int64) for c in ("whole", "question", "answer")) for _, r in parsed.iterrows()]
    # a first look at the low bits of a word's hash
    maybe = np.zeros(1 << 20, bool)
    maybe[terms & (len(maybe) - 1)] = True
    return Index(
        terms, starts, items, weights, np.searchsorted(block_term, np.arange(len(terms) + 1)), cells % (len(names) // BLOCK + 1), block_max,
        most, needed, float(spare.max()) if len(spare) else 0.0, names, int(parsed["length"].max()) if len(parsed) else 1, parts, maybe,
    )


def spread_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range that each comes from."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[owner] + offset, owner


def windows(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of twice `words` words at every `words` words: start, end, text. Any item lies whole in one."""
    sizes = np.diff(first)
    counts = np.where(sizes > 0, np.maximum(1, -(-sizes // words) - 1), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first[:-1][text] + step * words
    return starts, np.minimum(starts + 2 * words, first[1:][text]), text


def search(index: Index, found: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float):
    """(passage, item, score) of all items above the threshold, by block-max pruning of a batch of passages.

    `found` has the term number of each word or -1. A passage is looked at if the largest impacts of its needed
    terms can reach an item; a block of items if the block maxima of the passage's terms reach the threshold; the
    postings are summed only within such blocks. None of the bounds can lose an item.
    """
    slack = 1e-9
    known = np.flatnonzero(found >= 0)
    ceiling = np.zeros(len(found) + 1)
    ceiling[known + 1] = np.where(index.needed[found[known]], index.most[found[known]], 0.0)
    ceiling = np.cumsum(ceiling)
    chosen = np.flatnonzero(ceiling[ends] - ceiling[starts] >= threshold - index.spare - slack)
    width = max(1, CELLS // max(len(index.names), index.n_blocks, 64))
    for s in range(0, len(chosen), width):
        some = chosen[s : s + width]
        at, owner = spread_ranges(np.searchsorted(known, starts[some]), np.searchsorted(known, ends[some]))
        pairs = np.unique(owner * len(index.terms) + found[known[at]])
        passage, term = pairs // len(index.terms), pairs % len(index.terms)
        at, owner = spread_ranges(index.block_starts[term], index.block_starts[term + 1])
        cell = passage[owner] * index.n_blocks + index.blocks[at]
        bound = np.bincount(cell, index.block_max[at], len(some) * index.n_blocks)
        open_ = bound >= threshold - slack
        alive = open_.reshape(len(some), -1).any(1)
        keep = alive[passage]
        passage, term = passage[keep], term[keep]
        at, owner = spread_ranges(index.starts[term], index.starts[term + 1])
        inside = open_[passage[owner] * index.n_blocks + index.items[at] // BLOCK]
        at, owner = at[inside], owner[inside]
        score = np.bincount(passage[owner] * len(index.names) + index.items[at], index.impacts[at], len(some) * len(index.names))
        for hit in np.flatnonzero(score >= threshold - slack):
            yield int(some[hit // len(index.names)]), int(hit % len(index.names)), float(score[hit])


def share(part: np.ndarray, of: np.ndarray) -> float:
    return float(np.isin(of, part).mean()) if len(of) else 1.0


def verdict(hashes: np.ndarray, parts) -> tuple[bool, float, float]:
    """Whether a passage repeats an item, the overlap of the question and that of the answer."""
    whole, question, answer = parts
    # an item shorter than a shingle is one sequence, looked for at every place of its length
    mine = shingles(hashes)
    if len(hashes) >= SHINGLE and len(whole) == 1 or len(question) == 1:
        mine = np.concatenate([mine, *[sequence_shingles(hashes, n) for n in range(1, SHINGLE)]])
    asked, answered = share(mine, question), share(hashes.view(np.int64), answer)
    return share(mine, whole) >= QUESTION_SHARE or (asked >= QUESTION_SHARE and answered >= ANSWER_SHARE), asked, answered


def sequence_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """What `short_shingle` gives for each sequence of `n` words."""
    spans = [short_shingle(hashes[k : k + n], SHINGLE) for k in range(len(hashes) - n + 1)]
    return np.concatenate(spans) if spans else np.zeros(0, np.int64)


def indexes(items: DataFrame, threshold: float):
    """The indexes of all items (item_id, text), of at most about `INDEX_ITEMS` each; an empty one without items."""
    parsed = store(parsed_items(items), "items-parsed")
    weights = store(impacts(parsed), "impacts")
    parts = max(1, -(-parsed.count() // INDEX_ITEMS))
    piece = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    for p in range(parts):
        yield build_index(parsed.where(piece == p).toPandas(), weights.where(piece == p).toPandas(), threshold)


def contaminated(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The test items that documents repeat: key, item_id, score, question_overlap, answer_overlap, position.

    Words are lower-cased runs of letters and digits. Each item is indexed with BM25 impacts, as shares of its own
    score. Every document is cut into overlapping passages, twice as long as the longest item; each passage is a
    query, and every item of whose score it reaches `threshold` is retrieved. A retrieved item counts if the passage
    holds 0.8 of its shingles of five words, or 0.8 of its question's and half of the words of its answer (the last
    sentence). A pair of document and item has one row, its best passage (overlaps, score, then the first).

    Null and empty texts, and items without a word, match nothing; an item of fewer than five words is one sequence.
    Repeated rows and repeated keys give one row a pair. A null key or item keeps its rows under null. Extra columns
    are not read. Empty tables give an empty table. The index is sent to tasks in parts of at most 20,000 items, each
    searched by all passages; documents are not shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    # items get a number of their own, so that repeated ids stay apart
    items = items.select(F.col(item).cast("long").alias("_name"), F.col(item_text).alias("text"))
    items = store(items.withColumn("item_id", F.monotonically_increasing_id()), "items")
    hits = None
    for index in indexes(items.select("item_id", "text"), threshold):
        some = search_documents(docs, index, threshold)
        hits = some if hits is None else hits.unionByName(some)
    named = hits.join(items.select("item_id", "_name"), "item_id")
    rank = F.struct("question_overlap", "answer_overlap", "score", -F.col("position"))
    best = named.groupBy("_doc", "_name").agg(F.max_by(F.struct("score", "question_overlap", "answer_overlap", "position"), rank).alias("best"))
    return best.select(F.col("_doc").alias(key), F.col("_name").alias("item_id"), "best.*")


def verified(index: Index, texts: pa.Array, threshold: float):
    """(text, item, score, question overlap, answer overlap, position) of all items that the texts repeat."""
    hashes, first = word_hashes(folded(texts), SIGNS)
    signed = hashes.view(np.int64)
    found = np.full(len(hashes), -1, np.int64)
    near = np.flatnonzero(index.maybe[signed & (len(index.maybe) - 1)])
    place = np.minimum(np.searchsorted(index.terms, signed[near]), len(index.terms) - 1)
    same = index.terms[place] == signed[near] if len(index.terms) else np.zeros(len(near), bool)
    found[near[same]] = place[same]
    starts, ends, owner = windows(first, index.words)
    for passage, item, score in search(index, found, starts, ends, threshold):
        good, asked, answered = verdict(hashes[starts[passage] : ends[passage]], index.parts[item])
        if good:
            doc = int(owner[passage])
            yield doc, int(index.names[item]), score, asked, answered, int(starts[passage] - first[doc])


def search_documents(docs: DataFrame, index: Index, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = "_doc long, item_id long, score double, question_overlap double, answer_overlap double, position long"

    def rows(batches):
        for batch in pieces(batches, "_text", SLICE):
            out = list(verified(held.value, batch.column("_text"), threshold))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                keys = batch.column("_doc").take(pa.array(columns[0]))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], [f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(rows, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that repeat no test item (see `contaminated`), all columns as they are.

    Rows are judged one by one where they lie, so null and repeated keys need no care; rows with a null or empty
    text stay. Without items all rows stay. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    for index in indexes(items.select(F.col(item_text).alias("text")).withColumn("item_id", F.monotonically_increasing_id()), threshold):
        docs = without_hits(docs, text, index, threshold)
    return docs


def without_hits(docs: DataFrame, text: str, index: Index, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches):
        yield from clean_rows(batches, text, held.value, threshold)

    return docs.mapInArrow(rows, docs.schema)


def clean_rows(batches, text: str, index: Index, threshold: float):
    for batch in pieces(batches, text, SLICE):
        clean = np.ones(batch.num_rows, bool)
        clean[[hit[0] for hit in verified(index, batch.column(text), threshold)]] = False
        yield batch.filter(pa.array(clean))
