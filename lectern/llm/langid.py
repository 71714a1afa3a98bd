"""Language identification by segmentation-marginalised unigrams over a fixed public piece vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import bucket_of, pieces, prepare, store
from lectern.llm.wordhash import text_buffers, word_hashes, word_spans

#: A public sentence-piece vocabulary; read on the driver and sent to tasks as strings.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of a language that the piece probabilities are fitted on.
SAMPLE_ROWS = 2000
ROUNDS = 3
#: Added to each expected count, so that a piece never seen in a language keeps a chance.
SMOOTHING = 0.05
#: What a letter outside the vocabulary has in every language.
UNKNOWN = 1e-9
#: A run of letters is read in parts of so many, which keeps products of probabilities within a double.
PART = 30
START = "▁"


def letter_pieces(path: str) -> list[str]:
    """The pieces of lower-case letters, some with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(k) for k in range(model.get_piece_size()) if not model.is_byte(k) and not model.is_control(k)}
    return sorted(n for n in names if n == n.lower() and (n.removeprefix(START).isalpha() or n == START))


class Vocabulary:
    """Pieces by the hash of their characters, for many look-ups at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, names: list[str]):
        self.names = names
        self.longest = max(map(len, names), default=1)
        self.bits = max(8, int(np.ceil(np.log2(max(len(names), 1)))) + 3)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int64)
        for k, name in enumerate(names):
            key = self.hashes(np.array([[ord(c) for c in name]]))[-1]
            slot = int(self.slot(key)[0])
            while self.ids[slot] >= 0:
                slot = (slot + 1) & (len(self.ids) - 1)
            self.keys[slot], self.ids[slot] = key[0], k

    def slot(self, keys):
        return ((keys * self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def hashes(cls, codes: np.ndarray) -> list[np.ndarray]:
        """For each length n the hash of the first n characters of every row."""
        out = [np.zeros(len(codes), np.uint64)]
        for column in codes.T:
            out.append(out[-1] * cls.FACTOR + column.astype(np.uint64) + np.uint64(1))
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        slot = self.slot(keys)
        found = np.where(self.keys[slot] == keys, self.ids[slot], -1)
        left = np.flatnonzero((found < 0) & (self.ids[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.ids) - 1)
            here = slot[left]
            hit = (self.keys[here] == keys[left]) & (self.ids[here] >= 0)
            found[left[hit]] = self.ids[here[hit]]
            left = left[~hit & (self.ids[here] >= 0)]
        return found


def arcs(vocabulary: Vocabulary, codes: np.ndarray):
    """(i, j, rows, piece numbers): the pieces that fill characters i to j of some rows, by j, then i.

    A single character that is no piece counts as piece -1.
    """
    sums = vocabulary.hashes(codes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(codes.shape[1] + 1, Vocabulary.FACTOR, np.uint64), dtype=np.uint64)
    for j in range(1, codes.shape[1] + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            found = vocabulary.find(sums[j] - sums[i] * powers[j - i - 1])
            if i == j - 1:
                yield i, j, np.arange(len(codes)), found
            else:
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield i, j, rows, found[rows]


def forward(vocabulary: Vocabulary, codes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """log P(word) for each row and language: the sum over all segmentations. `chances`: a row for each piece and one
    for unknown characters at the end."""
    alpha = [np.ones((len(codes), chances.shape[1]))] + [np.zeros((len(codes), chances.shape[1])) for _ in range(codes.shape[1])]
    for i, j, rows, found in arcs(vocabulary, codes):
        alpha[j][rows] += alpha[i][rows] * chances[found]
    return np.log(alpha[-1])


def expected_counts(vocabulary: Vocabulary, codes: np.ndarray, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, by forward and backward sums."""
    n, length = codes.shape
    steps = list(arcs(vocabulary, codes))
    alpha = [np.ones(n)] + [np.zeros(n) for _ in range(length)]
    for i, j, rows, found in steps:
        alpha[j][rows] += alpha[i][rows] * chances[found]
    beta = [np.zeros(n) for _ in range(length)] + [np.ones(n)]
    counts = np.zeros(len(chances))
    for i, j, rows, found in reversed(sorted(steps, key=lambda s: (s[1], s[0]))):
        through = chances[found] * beta[j][rows]
        beta[i][rows] += through
        np.add.at(counts, found, weights[rows] * alpha[i][rows] * through / alpha[-1][rows])
    return counts


def words_by_length(words: list[str]):
    """Row numbers and character codes, a group for each length; the mark of a word's start comes first."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        text = "".join(START + words[r] for r in rows)
        yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), size + 1)


def letters_only(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"\P{L}+", " "))


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of letters in the texts, for each run its number, and each text's first run."""
    clean = letters_only(texts)
    hashes, first = word_hashes(clean)
    _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    offsets, data = text_buffers(clean)
    starts, ends = word_spans(offsets, data)
    whole = data.tobytes()
    return [whole[s:e].decode("utf-8") for s, e in zip(starts[at], ends[at])], number, first


def word_scores(vocabulary: Vocabulary, words: list[str], chances: np.ndarray) -> np.ndarray:
    """log P of each word in each language; a long run is the product of its parts."""
    scores = np.zeros((len(words), chances.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= PART]
    for rows, codes in words_by_length([words[k] for k in short]):
        scores[np.array(short)[rows]] = forward(vocabulary, codes, chances)
    for k, w in enumerate(words):
        if len(w) > PART:
            parts = [w[s : s + PART] for s in range(0, len(w), PART)]
            scores[k] = word_scores(vocabulary, parts, chances).sum(0)
    return scores


# -- fitting -------------------------------------------------------------------------------------------------------


def sample_words(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """lang, word, n of at most `rows_per_language` learning rows of each language, those with the smallest hash."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language)
    texts = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")

    def rows(batches):
        for batch in pieces(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                texts = batch.column("text").filter(pa.array(langs == lang))
                words, number, _ = distinct_words(texts)
                times = np.bincount(number, minlength=len(words)).tolist()
                parts = [(w[s : s + PART], n) for w, n in zip(words, times) for s in range(0, len(w), PART)]
                words, times = [p for p, _ in parts], [n for _, n in parts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_by_language(words: DataFrame, vocabulary: Vocabulary, langs: list[str], chances: np.ndarray) -> np.ndarray:
    """Expected piece counts, summed over tasks: a row for each piece, a column for each language."""
    held = words.sparkSession.sparkContext.broadcast((vocabulary, chances))

    def rows(batches):
        vocabulary, chances = held.value
        totals = np.zeros_like(chances)
        for batch in batches:
            column = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            weights = batch.column("n").to_numpy().astype(float)
            names = batch.column("word").to_pylist()
            for lang in np.unique(column):
                mine = np.flatnonzero(column == lang)
                for at, codes in words_by_length([names[k] for k in mine]):
                    totals[:, lang] += expected_counts(vocabulary, codes, chances[:, lang], weights[mine[at]])
        piece, lang = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(totals[piece, lang])], ["piece", "lang", "n"])

    sums = words.mapInArrow(rows, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros_like(chances)
    totals[sums["piece"], sums["lang"]] = sums["n"]
    return totals


def smoothed(counts: np.ndarray) -> np.ndarray:
    known = counts[:-1] + SMOOTHING
    return np.vstack([known / known.sum(0), np.full((1, counts.shape[1]), UNKNOWN)])


class Model:
    def __init__(self, vocabulary: Vocabulary, langs: list[str], chances: np.ndarray, priors: np.ndarray):
        self.vocabulary, self.langs, self.chances, self.priors = vocabulary, langs, chances, priors


def fit(learn: DataFrame, vocabulary_path: str = VOCABULARY, rows_per_language: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language in `learn` (doc_id, text, lang) by expectation maximisation.

    The number of rows a language that they are fitted on is bounded; the share of a language in all of `learn` is
    its prior. What reaches the driver is bounded by vocabulary times languages.
    """
    learn = learn.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    shares = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    vocabulary = Vocabulary(letter_pieces(vocabulary_path))
    priors = np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values())))
    chances = np.full((len(vocabulary.names) + 1, len(langs)), 1.0 / (len(vocabulary.names) + 1))
    chances[-1] = UNKNOWN
    if langs:
        words = store(sample_words(learn, rows_per_language), "langid-words")
        for _ in range(rounds):
            chances = smoothed(expected_by_language(words, vocabulary, langs, chances))
    return Model(vocabulary, langs, chances, priors)


# -- scoring -------------------------------------------------------------------------------------------------------


def classify(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's best language (beyond the last: undetermined) and its posterior."""
    words, number, first = distinct_words(texts)
    if not model.langs:
        return np.full(len(texts), 0), np.zeros(len(texts))
    scores = word_scores(model.vocabulary, words, model.chances)
    sums = np.vstack([np.zeros((1, len(model.langs))), np.cumsum(scores[number], 0)]) if len(number) else np.zeros((1, len(model.langs)))
    total = sums[first[1:]] - sums[first[:-1]] + model.priors
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    empty = first[1:] == first[:-1]
    best[empty], score[empty] = len(model.langs), 0.0
    return best, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for rows of (doc_id, text), without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = held.value
        names = np.array([*model.langs, "und"], object)
        for batch in pieces(batches, "text"):
            best, score = classify(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float, learn: DataFrame | None = None, *, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose language is determined with a posterior of at least `least`, all columns as they are.

    The model is fitted on `learn` (by default `docs`; doc_id, text, lang) as in `identify`. Rows with a null text
    or one without a letter go, and all rows if there is nothing to learn from. Rows are judged one by one where they
    lie, so null and repeated keys need no care. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    learn = docs if learn is None else learn
    model = fit(learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.col("lang").cast("string").alias("lang")), **options)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = held.value
        for batch in pieces(batches, text):
            best, score = classify(model, batch.column(text))
            yield batch.filter(pa.array((best < len(model.langs)) & (score >= least)))

    return docs.mapInArrow(rows, docs.schema)


def identify(docs: DataFrame, learn: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, lang_pred, score of every row of `docs` (doc_id, text), by a model fitted on `learn` (doc_id, text, lang).

    Words are runs of letters in lower case. A word's probability in a language is the sum, over all its
    segmentations into vocabulary pieces, of the product of piece probabilities (forward algorithm); a text's is the
    product over all its words and the language's share. The score is the posterior of the best language.

    A null text and one without a letter are `und` with score 0, and so is every text if there is nothing to learn
    from. Rows of `learn` without language are left out. Of equal scores the first language in order is taken.
    Repeated rows are scored alike; extra columns are not read; an empty table gives an empty table. Texts are read
    whole; a run of more than 30 letters counts as the product of its parts.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = docs if learn is None else learn
    model = fit(learn.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")), **options)
    return predict(rows, model)


def identify_query(documents: DataFrame) -> DataFrame:
    learn = documents.where(bucket_of(F.col("doc_id"), 4) != 2)
    scored = identify(documents, learn)
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
