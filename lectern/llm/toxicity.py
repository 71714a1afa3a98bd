"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import bucket_of, pieces, prepare, store
from lectern.llm.wordhash import SIGNS, word_hashes

#: Labelled rows that voters, label model and classifier are fitted on, those with the smallest hash of the key.
SAMPLE_ROWS = 12_000
#: Features are words and their first bytes, hashed into so many places.
PLACES = 1 << 18
HEADS = (4, 5, 6)
#: Mined lexicons: their number, and the terms dealt to them.
MINED_VOTERS, MINED_TERMS = 8, 400
#: A mined term occurs in so many toxic rows at least, and is so many times likelier there.
LEAST_ROWS, LEAST_RATIO = 5, 4.0
EM_ROUNDS = 40
#: Strength of the classifier's L1 penalty.
PENALTY = 5e-4

# Lexicons in English, German, French and Spanish; each is one voter.
LEXICONS = {
    "insults": "idiot moron loser stupid dumb pathetic worthless clown trash scum disgusting fool imbecile dumm blöd trottel depp "
    "idiote crétin imbécile nul connard abruti tonto estúpido imbécil inútil payaso basura",
    "profanity": "fuck fucking shit bitch bastard asshole crap damn scheiße arschloch hure merde putain salope mierda puta cabrón joder",
    "threats": "kill die murder hang shoot burn destroy töten sterben umbringen tuer crever mourir matar morir muere",
    "contempt": "hate vermin filth scumbag subhuman parasite hasse abschaum ungeziefer haine vermine ordure odio escoria alimaña",
}
# Patterns that vote.
VOTING_PATTERNS = {
    "addressed": r"(?i)\b(?:you(?:'re| are)?|du bist|tu es|eres)\s+(?:such\s+)?(?:an?\s+)?(?:idiot|moron|loser|stupid|dumb|pathetic|worthless|clown|trash|scum|disgusting)",
    "shouting": r"(?:\b[A-Z]{4,}\b\W+){3}",
    "exclaimed": r"!{3,}",
    "stretched": r"(?i)([a-z])\1{4,}",
    "masked": r"(?i)\b[a-z]+[*#@$]{2,}[a-z]*\b",
}


# -- features ------------------------------------------------------------------------------------------------------


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature places of all words and heads of words, unsorted, with repeats."""
    heads = [(n, []) for n in HEADS]
    hashes, first = word_hashes(pc.utf8_lower(pc.fill_null(texts, "")), SIGNS, heads)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    owners, found = [owner], [hashes]
    for _, (column,) in heads:
        some = np.flatnonzero(column)
        owners.append(owner[some])
        found.append(column[some])
    return np.concatenate(owners), (np.concatenate(found) & np.uint64(PLACES - 1)).astype(np.int64)


def fixed_votes(text: str | None) -> int:
    """The lexicons and patterns that fire, as bits."""
    words = set(re.findall(r"\w+", (text or "").lower()))
    fired = [not words.isdisjoint(terms.split()) for terms in LEXICONS.values()]
    fired += [re.search(p, text or "") is not None for p in VOTING_PATTERNS.values()]
    return sum(1 << k for k, f in enumerate(fired) if f)


def sample_features(docs: DataFrame) -> DataFrame:
    """doc_id, toxic, distinct feature places and fixed votes of the sample."""

    def rows(batches):
        for batch in pieces(batches, "text"):
            owner, place = places(batch.column("text"))
            keys = np.unique(owner * PLACES + place)
            cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) * PLACES)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((keys % PLACES).astype(np.int32)))
            votes = [fixed_votes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists, pa.array(votes, pa.int32())], ["doc_id", "toxic", "places", "fixed"])

    return docs.mapInArrow(rows, "doc_id long, toxic int, places array<int>, fixed int")


def mined_lexicons(sample: DataFrame) -> list[list[int]]:
    """The features that stand out in the rows labelled toxic, dealt to voters by rank."""
    toxic, clean = (sample.where(F.col("toxic") == v).count() for v in (1, 0))
    if not toxic or not clean:
        return []
    terms = sample.select("toxic", F.explode("places").alias("place")).groupBy("place")
    terms = terms.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= LEAST_ROWS)
    p, q = F.col("t") / toxic, (F.col("c") + 0.5) / (clean + 1)
    mean = (F.col("t") + F.col("c")) / (toxic + clean)
    score = (p - q) / F.sqrt(mean * (1 - mean) + F.lit(1e-9))
    top = terms.where(p >= q * LEAST_RATIO).orderBy(score.desc(), "place").limit(MINED_TERMS).select("place").collect()
    return [[r["place"] for r in top[k::MINED_VOTERS]] for k in range(MINED_VOTERS)]


def all_votes(sample: DataFrame, mined: list[list[int]]) -> DataFrame:
    """Fixed and mined votes as one bit set."""
    votes = F.col("fixed").cast("long")
    offset = len(LEXICONS) + len(VOTING_PATTERNS)
    for k, terms in enumerate(mined):
        if terms:
            fires = F.arrays_overlap("places", F.array(*map(F.lit, terms)))
            votes = votes + F.when(fires, F.lit(1 << (offset + k))).otherwise(0)
    return sample.withColumn("votes", votes.cast("long"))


# -- label model ---------------------------------------------------------------------------------------------------


class LabelModel:
    """Voters given a hidden label: how often each fires under either label, and given one other voter.

    The other voter of each is its neighbour in the tree of strongest dependencies that the labels leave
    unexplained, so that voters which repeat each other don't count twice.
    """

    def __init__(self, voters: int):
        self.m = voters
        self.parent = np.full(voters, -1)
        self.prior = 0.1
        self.rates = np.tile([[0.02], [0.3]], (1, voters))  # label, voter
        self.pair = np.zeros((2, 2, voters))  # label, parent's vote, voter

    def log_likelihoods(self, votes: np.ndarray) -> np.ndarray:
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for y in (0, 1):
            for j in range(self.m):
                rate = np.full(len(votes), self.rates[y, j]) if self.parent[j] < 0 else self.pair[y, votes[:, self.parent[j]], j]
                out[:, y] += np.where(votes[:, j] == 1, np.log(rate), np.log(1 - rate))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ll = self.log_likelihoods(votes)
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))

    def update(self, votes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> None:
        total = counts.sum()
        self.prior = float(np.clip((counts * p).sum() / total, 1e-3, 1 - 1e-3))
        for y, w in ((0, counts * (1 - p)), (1, counts * p)):
            # a weak belief that voters seldom fire on clean rows and are right more often than wrong
            self.rates[y] = (w @ votes + (0.1, 1.0)[y]) / (w.sum() + 4)
            for j in range(self.m):
                if self.parent[j] >= 0:
                    for v in (0, 1):
                        at = w * (votes[:, self.parent[j]] == v)
                        self.pair[y, v, j] = (at @ votes[:, j] + 2 * self.rates[y, j]) / (at.sum() + 2)
        self.rates = np.clip(self.rates, 1e-4, 1 - 1e-4)
        self.pair = np.clip(self.pair, 1e-4, 1 - 1e-4)

    def correlate(self, votes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> None:
        """The tree of largest mutual information between voters given the label."""
        info = np.zeros((self.m, self.m))
        total = counts.sum()
        for w in (counts * (1 - p), counts * p):
            mass = w.sum() + 1e-9
            both = (votes * w[:, None]).T @ votes / mass
            single = np.diag(both)
            for a in (0, 1):
                for b in (0, 1):
                    joint = both if a and b else single[:, None] - both if a else single[None, :] - both if b else 1 - single[:, None] - single[None, :] + both
                    apart = np.outer(single if a else 1 - single, single if b else 1 - single)
                    info += mass / total * joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12))
        joined, rest = [0], set(range(1, self.m))
        while rest:
            gain, a, b = max((info[a, b], a, b) for a in joined for b in rest)
            self.parent[b] = a if gain > 1e-4 else -1
            joined.append(b)
            rest.discard(b)

    def fit(self, votes: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Expectation maximisation over the distinct vote patterns, first without and then with the tree."""
        p = 1 / (1 + np.exp(3.0 - 3.0 * votes.sum(1)))
        for round_ in range(EM_ROUNDS):
            if round_ == EM_ROUNDS // 2:
                self.correlate(votes, counts, p)
            self.update(votes, counts, p)
            p = self.posterior(votes)
        return self


def posterior_labels(voted: DataFrame, voters: int) -> DataFrame:
    """doc_id, places and the posterior of label 1; the vote patterns of the bounded sample are counted in Spark."""
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    bits = (patterns["votes"].to_numpy()[:, None] >> np.arange(voters)) & 1
    model = LabelModel(voters).fit(bits, patterns["n"].to_numpy(float))
    patterns["p"] = model.posterior(bits)
    table = voted.sparkSession.createDataFrame(patterns[["votes", "p"]].astype({"votes": "int64", "p": "float64"}))
    return voted.join(F.broadcast(table), "votes").select("doc_id", "places", "p")


# -- classifier ----------------------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept from the texts of `docs` with the labels (doc_id, toxic), of which a bounded sample is used."""
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    sample = store(sample_features(rows.select("doc_id", "text", "toxic")), "toxicity-sample")
    if sample.isEmpty():
        return np.zeros(PLACES), -np.inf
    mined = mined_lexicons(sample)
    labelled = posterior_labels(all_votes(sample, mined), len(LEXICONS) + len(VOTING_PATTERNS) + len(mined))
    sparse = F.udf(lambda at: Vectors.sparse(PLACES, sorted(at), [1.0] * len(at)), VectorUDT())
    rows = labelled.select(sparse("places").alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )).alias("w")).select("features", "w.*").where("weight > 0.001")
    rows = rows.persist()
    try:
        solver = LogisticRegression(weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60, aggregationDepth=2)
        model = solver.fit(rows)
    finally:
        rows.unpersist()
    matrix = model.coefficientMatrix.toArray()[0]
    return matrix, float(model.interceptVector[0])


def score_texts(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id and score of rows of (doc_id, text): each distinct feature of a whole text counts once."""
    held = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    def rows(batches):
        weights, intercept = held.value
        used = weights != 0
        for batch in pieces(batches, "text"):
            owner, place = places(batch.column("text"))
            some = np.flatnonzero(used[place])
            keys = np.unique(owner[some] * PLACES + place[some])
            total = np.bincount(keys // PLACES, weights[keys % PLACES], batch.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of each row of `docs` (doc_id, text).

    Fixed lexicons and patterns, and lexicons mined from the rows that `labels` (doc_id, toxic) marks, vote on a
    bounded sample of the marked rows. A generative model of hidden label and correlated voters gives each row a posterior;
    an L1 logistic regression on hashed words and word beginnings learns the posteriors. Scoring reads whole texts
    without a shuffle.

    Null and empty texts score as a text without any feature. Labels with a null key or a value other than
    0 and 1 are left out, of several for a key the largest counts; without any every score is 0. Repeated rows are scored alike; extra columns are
    not read; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    scored = score_texts(docs, *fit(docs, labels, sample_rows))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(documents, labels.where(bucket_of(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
