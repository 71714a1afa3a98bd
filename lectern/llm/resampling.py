"""Importance resampling towards a target: hashed n-grams of concatenated batches, Gumbel top-k draws."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import pieces, prepare, store

#: Runs of these bytes are words: digits, a-z and all beyond ASCII (A-Z are lower-cased before).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Stands between two texts of a batch and belongs to no word.
SENTINEL = b"\x00"
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of a joined batch whose words are held at once.
WINDOW = 1 << 20
#: Words up to this length are hashed column by column, longer ones one by one.
SHORT = 24


@cache
def crc_table() -> np.ndarray:
    """The state of the checksum's register after one byte of the state and nothing else."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


@cache
def shift_tables() -> np.ndarray:
    """[n, k, v]: what byte k of a register, holding v, becomes after n zero bytes, for n up to SHORT."""
    table = crc_table()
    state = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [state]
    for _ in range(SHORT):
        state = table[state & 255] ^ (state >> 8)
        out.append(state)
    return np.stack(out)


def shifted(crcs: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The checksums carried over `n` further bytes; xor with those bytes' own checksum gives that of both together."""
    tables = shift_tables()
    return tables[n, 0, crcs & 255] ^ tables[n, 1, (crcs >> 8) & 255] ^ tables[n, 2, (crcs >> 16) & 255] ^ tables[n, 3, crcs >> 24]


def word_crcs(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every word."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -SHORT, side="left"))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(buffer[starts[i] : ends[i]])
    order = order[long:]
    data, table = np.frombuffer(buffer, np.uint8), crc_table()
    state, at, left = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], sizes[order]
    for p in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -p, side="left"))
        state[:n] = table[(state[:n] ^ data[at[:n] + p]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def bigram_crcs(buffer: bytes, crcs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every word but the last, one space and the word after it."""
    first = shifted(crcs[:-1], 1) ^ np.uint32(zlib.crc32(b" "))
    sizes = (ends - starts)[1:]
    out = shifted(first, np.minimum(sizes, SHORT)) ^ crcs[1:]
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(buffer[starts[i + 1] : ends[i + 1]], int(first[i]))
    return out


def batch_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all features of a batch, in windows of the joined texts.

    The texts are joined by sentinels, so one regular expression finds the words of all; a word's text is where its
    position falls among the texts' offsets, and pairs of words from two texts are masked. A window ends between two
    words, and its last word is met again by the next window's first one, so long texts need no more memory.
    """
    raw = [t.encode() for t in pc.fill_null(texts, "").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    buffer = SENTINEL.join(raw).lower()
    begin, last = 0, None
    while begin < len(buffer):
        cut = NO_WORD.search(buffer, min(begin + WINDOW, len(buffer)))
        stop = cut.end() if cut else len(buffer)
        spans = chain.from_iterable([m.span() for m in WORD.finditer(buffer, begin, stop)])
        starts, ends = np.fromiter(spans, np.int64).reshape(-1, 2).T
        begin = stop
        if not len(starts):
            continue
        crcs = word_crcs(buffer, starts, ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        yield doc, crcs % BUCKETS
        if last is not None:  # the word before this window
            starts, ends, crcs, doc = (np.concatenate([[a], b]).astype(b.dtype) for a, b in zip(last, (starts, ends, crcs, doc)))
        last = starts[-1], ends[-1], crcs[-1], doc[-1]
        same = doc[1:] == doc[:-1]
        yield doc[1:][same], bigram_crcs(buffer, crcs, starts, ends)[same] % BUCKETS


def bucket_counts(df: DataFrame, text: str) -> np.ndarray:
    """Features in each bucket over all texts: a task adds up its own, so it sends one row for each bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in pieces([batch], "t"):
                for _, buckets in batch_features(piece.column("t")):
                    total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed corpus share), a whole number for each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(key: str, seed: int):
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256 of seed and key; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(df: DataFrame, order: list) -> DataFrame:
    """`df` with its rows' place in `order`, from 1, as `place`.

    The rows are sorted by range; each task numbers its own, and the counts of the ranges before it are added. The last
    column of `order` is unique, so rows equal in all others are cut into ranges too.
    """
    spark = df.sparkSession

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_at"])
            seen += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _at long"
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:  # one row for each task
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text",
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Draw documents towards the distribution of `target`: key, n_features, weight, score, rank; a row for each document.

    Features are all words and all pairs of successive words, hashed into buckets. A bucket's gain compares its share in
    the target with that in all documents; a document's weight is the floored mean gain of its features, 0 without any.
    Weight plus keyed Gumbel noise is the score; of the N documents of `min_words` words or more the
    floor(percent N / 100) best are drawn, ties to the smaller key (null last), and `rank` numbers them from 1.

    Null and empty texts have no features. Repeated rows are documents of their own; with equal keys and texts they tie
    and are interchangeable. A null key takes the noise of an empty one and is null in the result. Without target texts
    every bucket's target share is equal. An empty table gives an empty table. Extra columns are not read.

    The texts are read twice, once for the counts of the buckets and once for the weights; what is shuffled is one row
    for each bucket and task, and the numbers of a document for the draw.
    """
    spark = docs.sparkSession
    prepare(spark)
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    held = spark.sparkContext.broadcast(gains)

    def weigh(batches):
        for batch in batches:
            for piece in pieces([batch], "t"):
                n, total = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
                for doc, buckets in batch_features(piece.column("t")):
                    n += np.bincount(doc, minlength=piece.num_rows)
                    np.add.at(total, doc, held.value[buckets])
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array(n), pa.array(weight)], ["k", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    scored = rows.mapInArrow(weigh, "k long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + gumbel("k", seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = store(scored, "scores")
    enough = F.col("n_features") >= 2 * min_words - 1
    able = scored.where(enough)
    drawn = able.count() * percent // 100
    places = numbered(able, [F.desc("score"), F.asc_nulls_last("k"), F.asc("_row")])
    ranked = places.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    out = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("k").alias(key), "n_features", "weight", "score", "rank")


def resample_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """`resample` with its default parameters for DuckDB; the checksum is taken byte by byte for each distinct feature."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH crc AS (
  SELECT list(list_reduce(range(0, 8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b) ORDER BY b) AS t
  FROM range(0, 256) r(b)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM {documents}),
q AS (SELECT regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{lower}'), '{words}') AS w FROM {benchmark}),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest({of}) AS f FROM d) GROUP BY ALL),
qf AS (SELECT f, count(*) AS n FROM (SELECT unnest({of}) AS f FROM q) GROUP BY ALL),
f AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM qf)),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
      lambda s, v: xor(s >> 8, crc.t[(xor(s, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM f, crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN b USING (f) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS t FROM qf JOIN b USING (f) GROUP BY ALL),
sums AS (SELECT (SELECT COALESCE(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT COALESCE(sum(t), 0) FROM t)::DOUBLE AS big_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((COALESCE(t, 0)::DOUBLE + 1) * (big_s + {BUCKETS})) / ((s::DOUBLE + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN b USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN w USING (r)),
places AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {2 * MIN_WORDS - 1})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (r)"""
