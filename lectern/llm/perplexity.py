"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import pieces, prepare, store

ORDER = 5
#: A character is one of 4096 classes: code points below 2048 are their own (digits one), others share the rest.
BITS, OWN = 12, 2048
BEGIN, END, OTHER, DIGIT = 1, 2, 3, 48
CLASSES = 1 << BITS
#: n-grams whose probabilities every task gets (16 bytes each); all others are looked up by joins.
FREQUENT = 1 << 19
#: Documents above this quantile of the trusted ones of their language go.
QUANTILE = 0.995
#: Bits a character that a text of one character may have more; it falls with the root of the length, as the
#: deviation of a mean does, so that short clean texts are not judged by chance.
SHORT = 2.0
#: Steps of a bit in which perplexity is compared with quantiles.
STEPS = 1000
#: Bits of the filter that keeps most untrusted documents out of the training shuffle (a proven bound).
FILTER_BITS = 1 << 22


# -- n-grams -------------------------------------------------------------------------------------------------------


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Character classes of code points."""
    out = np.where(codes < OWN, codes, OWN + codes % (CLASSES - OWN)).astype(np.int64)
    out[(codes >= 48) & (codes <= 57)] = DIGIT
    out[codes < 3] = OTHER
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as integers, one for each character and one for each end; each text's first."""
    texts = [t or "" for t in texts]
    pad = "\0" * (ORDER - 1)
    flat = pad.join(["", *[t + "\0" for t in texts]])
    codes = classes_of(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum([0, *sizes])
    ends = first[1:] + (ORDER - 1) * np.arange(1, len(texts) + 1) - 1
    codes[ends] = END
    for k in range(1, ORDER):
        codes[ends - sizes + 1 - k] = BEGIN
    keys = np.zeros(len(codes) - ORDER + 1, np.int64)
    for k in range(ORDER):
        keys = (keys << BITS) | codes[k : k + len(keys)]
    where = np.repeat(ends - sizes + 1 - first[:-1], sizes) + np.arange(first[-1])
    return keys[where - ORDER + 1], first


def count_grams(texts: DataFrame) -> DataFrame:
    """gram and count of the rows of (packed), compressed texts."""

    def rows(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        seen = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            texts, held = [], 0
            for k, packed in enumerate(batch.column("packed")):
                texts.append(unpack.decompress(packed.as_buffer()).decode("utf-8"))
                held += len(texts[-1])
                if held > 1 << 21 or k == batch.num_rows - 1:
                    fresh, times = np.unique(grams(texts)[0], return_counts=True)
                    keys, place = np.unique(np.concatenate([seen[0], fresh]), return_inverse=True)
                    total = np.bincount(place, np.concatenate([seen[1], times]), len(keys)).astype(np.int64)
                    seen, texts, held = (keys, total), [], 0
                    if len(keys) > 2_000_000:  # a task sends what it holds and goes on
                        yield from sent(seen)
                        seen = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from sent(seen)

    def sent(seen):
        for s in range(0, len(seen[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[0][s : s + 100_000]), pa.array(seen[1][s : s + 100_000])], ["gram", "c"])

    return texts.mapInArrow(rows, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def filter_bits(places: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, packed, of which those at the places p are set; tasks fold places into words of 64 bits."""
    word = F.shiftright("p", 6).alias("w")
    words = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("set"))
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    for at, values in packed_columns(words, ["w", "set"]):
        bits[at] = values
    return np.packbits(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def packed_columns(rows: DataFrame, columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of 64 bits as arrays, a batch at a time: they pass the driver as bytes, not as rows."""
    kinds = [np.float64 if dict(rows.dtypes)[c] == "double" else np.int64 for c in columns]

    def pack(batches):
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(k).tobytes() for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], columns)

    packed = rows.select(*columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns))
    for row in packed.collect():
        yield tuple(np.frombuffer(v, k) for v, k in zip(row, kinds))


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """packed: the texts of the documents whose key is in `trusted`, compressed before they are shuffled."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    held = docs.sparkSession.sparkContext.broadcast(filter_bits(trusted.select(place.alias("p"))))

    def rows(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        bits = np.unpackbits(held.value).view(bool)
        for batch in pieces(batches, "text"):
            batch = batch.filter(pa.array(bits[batch.column("p").to_numpy()]))
            packed = [pack.compress(t.as_buffer() or b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    texts = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", place.alias("p"), "text").mapInArrow(rows, "doc_id long, packed binary")
    return texts.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").select("packed")


# -- the model -----------------------------------------------------------------------------------------------------


def low_bits(gram: Column, k: int) -> Column:
    """The last `k` characters."""
    return gram.bitwiseAND(F.lit((1 << BITS * k) - 1))


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and more, from the counts of counts."""
    n = {r["c"]: r["n"] for r in level.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Tables:
    """Probabilities of the n-grams that occur, and the weights that contexts give to shorter ones, by order."""

    def __init__(self, counts: DataFrame):
        self.chance, self.back = {}, {}
        levels = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):  # in how many ways an n-gram is continued to the left
            levels[k] = store(levels[k + 1].groupBy(low_bits(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c")), f"grams-{k}")
        for k in range(1, ORDER + 1):
            d1, d2, d3 = discounts(levels[k])
            less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            rows = levels[k].withColumn("context", F.shiftright("gram", BITS)).withColumn("less", less)
            back = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("less").alias("less"))
            back = back.select("context", "total", (F.col("less") / F.col("total")).alias("back"))
            rows = rows.join(back, "context").select("gram", ((F.col("c") - F.col("less")) / F.col("total")).alias("own"), "back", "c")
            if k == 1:
                chance = F.col("own") + F.col("back") / CLASSES
                rows = rows.select("gram", chance.alias("p"), "c")
            else:
                lower = self.chance[k - 1].select(F.col("gram").alias("tail"), F.col("p").alias("q"))
                rows = rows.join(lower, low_bits(F.col("gram"), k - 1) == F.col("tail"))
                rows = rows.select("gram", (F.col("own") + F.col("back") * F.col("q")).alias("p"), "c")
            self.chance[k] = store(rows, f"chance-{k}")
            self.back[k] = store(back.select("context", "back"), f"back-{k}")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """gram and p for any n-grams of the highest order: the longest known ending, weighted by the contexts."""
        rows = keys.select("gram", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
        for k in range(ORDER, 0, -1):
            known = self.chance[k].select(F.col("gram").alias("tail"), F.col("p").alias("q"))
            context = self.back[k].select("context", "back")
            rows = rows.join(known, low_bits(F.col("gram"), k) == F.col("tail"), "left")
            rows = rows.withColumn("p", F.coalesce("p", F.col("weight") * F.col("q"))).drop("tail", "q")
            rows = rows.join(context, F.shiftright(low_bits(F.col("gram"), k), BITS) == F.col("context"), "left")
            rows = rows.withColumn("weight", F.col("weight") * F.coalesce("back", F.lit(1.0))).drop("context", "back")
        return rows.select("gram", F.coalesce("p", F.col("weight") / CLASSES).alias("p"))


class Held:
    """The log probabilities of frequent n-grams for many look-ups at once; those that collide twice are left out."""

    FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.logs = np.zeros(1 << self.bits)
        left = np.arange(len(keys))
        for factor in self.FACTORS:
            slot = self.slot(keys[left], factor)
            free = self.keys[slot] < 0
            _, once = np.unique(slot[free], return_index=True)
            put = left[free][once]
            place = slot[free][once]
            self.keys[place], self.logs[place] = keys[put], logs[put]
            left = np.setdiff1d(left, put)

    def slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and its log probability."""
        slot = self.slot(keys, self.FACTORS[0])
        hit = self.keys[slot] == keys
        logs = np.where(hit, self.logs[slot], 0.0)
        rest = np.flatnonzero(~hit)
        slot = self.slot(keys[rest], self.FACTORS[1])
        more = self.keys[slot] == keys[rest]
        logs[rest[more]] = self.logs[slot[more]]
        hit[rest[more]] = True
        return hit, logs


class Sent:
    """What a task gets as Held: the arrays travel, and the slots are made where they arrive, not on the driver."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    def __reduce__(self):
        return Held, (self.keys, self.logs)


def train(docs: DataFrame, trusted: DataFrame) -> Tables:
    return Tables(store(count_grams(trusted_texts(docs, trusted)), "grams"))


def log_chances(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, lang, n, logs for rows of (doc_id, lang, text): the sum over all characters and the end of each text.

    A row gets a number of its own as it is written, so repeated keys stay apart. A null or empty text has no sum.
    """
    spark = docs.sparkSession
    top = tables.chance[ORDER].orderBy(F.desc("c"), "gram").limit(FREQUENT).select("gram", F.ln("p").alias("l"))
    parts = list(zip(*packed_columns(top, ["gram", "l"]))) or [[np.zeros(0, np.int64)], [np.zeros(0)]]
    held = spark.sparkContext.broadcast(Sent(*map(np.concatenate, parts)))
    names = ["row", "doc_id", "lang", "n", "logs", "gram", "times"]

    def rows(batches):
        from pyspark import TaskContext

        next_row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text", 1 << 21):
            size = batch.num_rows
            texts = batch.column("text").to_pylist()
            keys, first = grams(texts)
            hit, logs = held.value.find(keys)
            owner = np.repeat(np.arange(size), np.diff(first))
            ids = np.arange(size) + next_row
            next_row += size
            empty = np.array([not t for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column("doc_id"), batch.column("lang"), pa.array(np.diff(first), mask=empty), pa.array(np.add.reduceat(logs, first[:-1]), mask=empty), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())],
                names,
            )
            rest = np.flatnonzero(~hit & ~empty[owner])
            if len(rest):
                order = rest[np.lexsort((keys[rest], owner[rest]))]
                new = np.flatnonzero(np.append(True, (np.diff(owner[order]) != 0) | (np.diff(keys[order]) != 0)))
                times = np.diff(np.append(new, len(order)))
                at, size = order[new], len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[at]]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64()), pa.array(keys[at]), pa.array(times)],
                    names,
                )

    schema = "row long, doc_id long, lang string, n long, logs double, gram long, times long"
    scored = store(docs.select("doc_id", "lang", "text").mapInArrow(rows, schema), "log-chances")
    held.destroy()
    rare = scored.where("gram IS NOT NULL").select("row", "gram", "times")
    known = tables.look_up(rare.select("gram").distinct())
    rare = rare.join(known, "gram").groupBy("row").agg(F.sum(F.col("times") * F.ln("p")).alias("more"))
    total = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return scored.where("gram IS NULL").select("row", "doc_id", "lang", "n", "logs").join(rare, "row", "left").select("doc_id", "lang", "n", total.alias("logs"))


# -- the filter ----------------------------------------------------------------------------------------------------


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """lang and limit: the quantile of the trusted documents' bits a character in each language.

    Counted on a grid of 1 / STEPS bits, whose size does not grow with the documents.
    """
    grid = scored.where("trusted AND bits IS NOT NULL").groupBy("lang", F.ceil(F.col("bits") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("lang").orderBy("step")
    ranked = grid.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    return ranked.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg((F.min("step") / STEPS).alias("limit"))


def quality(docs: DataFrame, trusted: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether its language's threshold keeps it.

    `docs` has doc_id, text, lang; `trusted` has the doc_id of trusted documents. The model is an interpolated
    modified Kneser-Ney model of character 5-grams, over 4096 character classes, that padding begins and an end mark
    ends; it counts all trusted texts. Returns doc_id, lang, n_grams (characters and the end), perplexity (a
    character), threshold, keep. The threshold is the quantile, over the trusted documents of the language, of bits a
    character less an allowance for short texts (SHORT), plus the document's allowance; over all trusted ones where
    the language has none. A document at the threshold is kept.

    Null and empty texts have no perplexity and are not kept. A null language is one of its own. A null key is scored
    and is never trusted. Repeated rows each get a row, and each trains if its key is trusted. Without trusted text
    no document has a threshold and all that have a perplexity are kept. Extra columns are not read. An empty table
    gives an empty table.

    Frequent n-grams are scored where the text lies; only the others, counted for each document, are joined with the
    model's tables, which are sharded by n-gram.
    """
    prepare(docs.sparkSession)
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    scored = log_chances(docs, train(docs, trusted))
    scored = scored.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
    bits = -F.col("logs") / F.col("n") / F.lit(math.log(2))
    judged = bits - SHORT / F.sqrt("n")
    scored = store(scored.select("doc_id", "lang", F.col("n").alias("n_grams"), bits.alias("whole"), judged.alias("bits"), F.coalesce("trusted", F.lit(False)).alias("trusted")), "bits")
    limits = thresholds(scored, quantile).select(F.col("lang").alias("_l"), "limit")
    overall = thresholds(scored.withColumn("lang", F.lit(None).cast("string")), quantile).select("limit").first()
    overall = F.lit(overall["limit"] if overall else None).cast("double")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn("limit", F.coalesce("limit", overall))
    keep = F.col("bits").isNotNull() & (F.col("limit").isNull() | (F.ceil(F.col("bits") * STEPS) <= F.round(F.col("limit") * STEPS)))
    return out.select("doc_id", "lang", "n_grams", F.pow(F.lit(2.0), "whole").alias("perplexity"), F.pow(F.lit(2.0), F.col("limit") + SHORT / F.sqrt("n_grams")).alias("threshold"), keep.alias("keep"))


def quality_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(documents, labels.where("quality = 1").select("doc_id"))
