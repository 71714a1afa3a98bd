"""Log-likelihood of whole documents: corpus counts, and a recurrent model trained where the documents lie."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import gru
from lectern.llm.shared import bucket_of, pieces, prepare, store
from lectern.llm.wordhash import word_hashes

FOLDS, HELD_FOLD = 7, 2
#: Words of the model, its end token and its class of all other words included; hidden units.
MODEL_WORDS, HIDDEN = 1024, 16
#: Words whose counts each task holds; the counts of all others are joined.
LOOKUP_WORDS = 1 << 17
#: Lanes and steps of a window, for training and for scoring.
TRAIN_LANES, TRAIN_STEPS, SCORE_LANES, SCORE_STEPS = 256, 32, 1024, 32
RATE = 0.1
#: Tokens that a task reads at once, at least one document.
BUFFER = 1 << 23
#: Each document trains in one of the rounds; between two rounds the tasks' weights are averaged. Shares in eighths.
ROUNDS = ((0, 2), (2, 8))
#: Models that one task averages, about: this many tokens make one.
TOKENS_PER_MODEL = 4_000_000
#: Buckets of an octave in the histogram of counts, by which the most frequent words are chosen.
PER_OCTAVE = 8
SEED = 11


def token_counts(rows: DataFrame) -> DataFrame:
    """(h, c, seen): each word's hash, its count in training texts, and in all texts; summed before they are shuffled."""

    def count(batches):
        for batch in batches:
            for piece in pieces([batch], "t"):
                words, first = word_hashes(piece.column("t"))
                if not len(words):
                    continue
                train = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
                order = np.argsort(words)
                words = words[order]
                starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                c = np.add.reduceat(train[order].astype(np.int64), starts)
                seen = np.diff(np.append(starts, len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(words[starts].view(np.int64)), pa.array(c), pa.array(seen)], ["h", "c", "seen"])

    counts = rows.select("held_out", "t").mapInArrow(count, "h long, c long, seen long")
    return counts.groupBy("h").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def least_count(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count, on a grid of PER_OCTAVE values an octave, that at most `most` words reach."""
    grid = F.floor(F.log2(column) * PER_OCTAVE).cast("int").alias("at")
    sizes = counts.where(F.col(column) > 0).groupBy(grid).agg(F.count("*").alias("n")).collect()  # a row for each grid value
    total, bound = 0, 0
    for at, n in sorted(((r["at"], r["n"]) for r in sizes), reverse=True):
        total += n
        if total > most:
            bound = at + 1
            break
    return max(2, int(np.ceil(2 ** (bound / PER_OCTAVE) - 1e-9))) if bound else 1


@dataclass
class Corpus:
    """What tasks need of the counts: totals, and the frequent words in the order of their hashes."""

    tokens: int  # N, end tokens included
    distinct: int  # V
    ends: int
    rare_tokens: int  # training tokens outside the model's vocabulary
    rare_distinct: int  # and how many different ones
    singles: int  # of these, those seen once
    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    model_counts: np.ndarray  # of the model's words, END and RARE first

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1.0)

    def unseen(self) -> float:
        """The share, among all words outside the model, of words that training texts don't have: that of words seen once."""
        return (self.singles + 1.0) / (self.rare_tokens + self.singles + 1.0)

    def unit(self) -> float:
        """What one occurrence of a word outside the model adds to its share; each has one more than were counted."""
        return (1 - self.unseen()) / max(self.rare_tokens + self.rare_distinct, 1)

    def inner(self, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share among all words outside the model."""
        return np.log10(np.where(c > 0, (c + 1.0) * self.unit(), self.unseen()))


def corpus_of(counts: DataFrame, ends: int, model_words: int, lookup_words: int) -> Corpus:
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("ones")).first()
    in_model, in_lookup = least_count(counts, "c", model_words - 2), least_count(counts, "seen", lookup_words)
    held = counts.where((F.col("c") >= in_model) | (F.col("seen") >= in_lookup)).toPandas().sort_values("h")  # bounded by the two numbers of words
    ids = np.full(len(held), gru.RARE, np.uint16)
    of_model = held[held["c"] >= in_model].sort_values(["c", "h"], ascending=[False, True])
    ids[np.searchsorted(held["h"].to_numpy(), of_model["h"].to_numpy())] = np.arange(2, 2 + len(of_model))
    rare = int(sums["n"] - of_model["c"].sum())
    model_counts = np.concatenate([[ends, rare], of_model["c"].to_numpy()]).astype(np.float64)
    ones = int(sums["ones"]) - int((of_model["c"] == 1).sum())
    return Corpus(int(sums["n"]) + ends, int(sums["v"]) + (ends > 0), ends, rare, int(sums["v"]) - len(of_model), ones, held["h"].to_numpy(), held["c"].to_numpy(), ids, model_counts)


def encoded(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """Each document's model ids as bytes, the sums of its frequent words, and the hashes of its other words."""
    held = rows.sparkSession.sparkContext.broadcast(corpus)
    names = ["k", "held_out", "ids", "n_tokens", "n_known", "base", "inner", "others"]

    def sums(values, at, n):
        return np.bincount(at, values, n) if len(at) else np.zeros(n)

    def encode(batches):
        corpus = held.value
        for batch in batches:
            for piece in pieces([batch], "t"):
                words, first = word_hashes(piece.column("t"))
                words, n = words.view(np.int64), piece.num_rows
                sizes = np.diff(first)
                doc = np.repeat(np.arange(n), sizes)
                at = np.minimum(np.searchsorted(corpus.hashes, words), max(len(corpus.hashes) - 1, 0))
                here = corpus.hashes[at] == words if len(corpus.hashes) else np.zeros(len(words), bool)
                ids = np.full(len(words), gru.RARE, np.uint16)
                ids[here] = corpus.ids[at[here]]
                c, doc_here = corpus.counts[at[here]] if len(corpus.hashes) else np.zeros(0), doc[here]
                outside = ids[here] == gru.RARE
                known = sums(c > 0, doc_here, n).astype(np.int64) + int(corpus.ends > 0)
                base = sums(corpus.base(c), doc_here, n) + np.log10(corpus.ends + 1.0)
                inner = sums(corpus.inner(c[outside]), doc_here[outside], n)
                bounds = first + np.arange(n + 1)  # with the end tokens in place
                whole = np.full(bounds[-1], gru.END, np.uint16)
                whole[np.arange(len(words)) + doc] = ids
                raw = pa.array([whole[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                counts = np.bincount(doc[~here], minlength=n) if len(doc) else np.zeros(n, np.int64)
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(words[~here]))
                columns = [piece.column("k"), piece.column("held_out"), raw, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(inner), others]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "k long, held_out boolean, ids binary, n_tokens long, n_known long, base double, inner double, others array<long>"
    return rows.mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id())


def documents_of(batches, columns: list[str]):
    """Lists of documents' ids of about BUFFER tokens, with their other columns."""
    docs, kept, tokens = [], [], 0
    for batch in batches:
        for i, raw in enumerate(batch.column("ids")):
            docs.append(np.frombuffer(raw.as_buffer(), np.uint16))
            tokens += len(docs[-1])
            kept.append(tuple(batch.column(c)[i].as_py() for c in columns))
            if tokens >= BUFFER:
                yield docs, kept
                docs, kept, tokens = [], [], 0
    if docs:
        yield docs, kept


def added(models: DataFrame) -> DataFrame:
    """The sum of all models of a task: whole numbers, so that any order gives the same."""

    def add(batches):
        total, steps = None, 0
        for batch in batches:
            for n, raw in zip(batch.column("steps").to_pylist(), batch.column("model")):
                weights = np.frombuffer(raw.as_buffer(), np.int64)
                total = weights.copy() if total is None else total + weights
                steps += n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([steps]), pa.array([total.tobytes()], pa.binary())], ["steps", "model"])

    return models.mapInArrow(add, "steps long, model binary")


def trained(documents: DataFrame, shape: gru.Shape, weights: np.ndarray, part: tuple[int, int], tokens: int, rate: float) -> np.ndarray:
    """Weights after one round: each task goes on from `weights` over its own documents of `part`, and the results are
    averaged by their number of steps."""
    held = documents.sparkSession.sparkContext.broadcast(weights)
    eighth = F.pmod(F.xxhash64("row"), F.lit(8))
    mine = documents.where(~F.col("held_out")).where((eighth >= part[0]) & (eighth < part[1])).select("ids")

    def learn(batches):
        now, done = held.value, 0
        for docs, _ in documents_of(batches, []):
            now, steps = gru.train(shape, now, docs, TRAIN_LANES, TRAIN_STEPS, rate)
            done += steps
        if done:
            total = gru.whole(now).astype(np.int64) * done
            yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([total.tobytes()], pa.binary())], ["steps", "model"])

    models = mine.mapInArrow(learn, "steps long, model binary")
    middle = max(1, round((tokens / TOKENS_PER_MODEL) ** 0.5))
    got = added(added(models.repartition(middle)).repartition(1)).collect()  # one model
    held.unpersist()
    if not got:
        return weights
    return (np.frombuffer(got[0]["model"], np.int64) / got[0]["steps"] * gru.GRAIN).astype(np.float32)


def scored(documents: DataFrame, shape: gru.Shape, weights: np.ndarray) -> DataFrame:
    """(row, model): natural log-probability of each document's model ids."""
    held = documents.sparkSession.sparkContext.broadcast(weights)

    def judge(batches):
        w = shape.unpack(held.value)
        for docs, kept in documents_of(batches, ["row"]):
            found = gru.score(w, docs, SCORE_LANES, SCORE_STEPS)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array(found)], ["row", "model"])

    return documents.select("row", "ids").mapInArrow(judge, "row long, model double")


def log_likelihood(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held_fold: int = HELD_FOLD,
    model_words: int = MODEL_WORDS, hidden: int = HIDDEN, lookup_words: int = LOOKUP_WORDS, rate: float = RATE,
) -> DataFrame:
    """Score whole documents: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(key as text) modulo `folds` is not `held_fold` train. Tokens are runs of anything but ASCII white
    space, A-Z lower-cased, then one end. `base_score` is the add-one unigram's log10 probability, from counts over all
    training texts. `score` is the model's: a gated recurrent network over the `model_words` most frequent words, the end,
    and one word that stands for all others; its softmax is factored into classes of words. A word outside the model
    has that word's probability times its own share among such words; words never seen in training are one event
    there, as they are in the base score, with the mass of the words seen once.

    Training reads every training text: in each round a task goes on from the last weights over its own documents, with
    truncated backpropagation in windows through which the state is carried, and the tasks' weights are averaged. Scoring
    carries the state through the whole document, whatever its length. How documents lie in partitions changes the weights,
    not the counts.

    Counts of frequent words travel as a table of at most about `lookup_words` + `model_words` words; all other words
    meet their counts in a join. Words are told apart by 64-bit hashes. Null and empty texts consist of their end. A null
    key trains. Repeated rows are documents of their own. With no training text all words are unseen and the model is
    uniform. An empty table gives an empty table. Extra columns are not read.
    """
    prepare(docs.sparkSession)
    fold = F.coalesce(bucket_of(F.col(key), folds), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("k"), (fold == held_fold).alias("held_out"), F.col(text).cast("string").alias("t"))
    counts = store(token_counts(rows), "counts")
    ends = rows.where(~F.col("held_out")).count()
    corpus = corpus_of(counts, ends, model_words, lookup_words)
    documents = store(encoded(rows, corpus), "tokens")

    shape = gru.Shape(len(corpus.model_counts), hidden)
    weights = gru.first_weights(shape, corpus.model_counts, SEED)
    for part in ROUNDS:
        weights = trained(documents, shape, weights, part, corpus.tokens, rate)
    models = scored(documents, shape, weights)

    # the words that no task holds the counts of
    others = documents.select("row", F.explode("others").alias("h")).join(counts.select("h", "c"), "h")
    share = F.when(F.col("c") > 0, (F.col("c") + 1.0) * corpus.unit()).otherwise(corpus.unseen())
    others = others.groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(F.log10(share)).alias("more_inner")
    )
    out = documents.drop("ids", "others").join(models, "row").join(others, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0.0))
    unit = float(np.log10(corpus.tokens + corpus.distinct + 1.0))
    return out.select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("model") / F.lit(float(np.log(10))) + F.col("inner") + more("more_inner")).alias("score"),
    )
