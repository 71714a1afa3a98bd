"""Jaccard similarity join on word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected
from lectern.llm.shared import pieces, prepare, store
from lectern.llm.wordhash import shingle_sets

#: The longest lengthening of a prefix: up to so many shared tokens can be asked for.
MOST_MATCHES = 4
#: What verifying a candidate costs, in units of looking at one posting.
VERIFY_COST = 20.0
#: A token in this many documents or more goes to the end of the order.
FREQUENT = 50
#: At most so many tokens are known as frequent (8 bytes each, sent to every task); others only cost time.
MOST_FREQUENT = 1 << 20
#: A task reports a token that it sees at least so often.
LOCAL_COUNT = 2
#: Minima under so many permutations name the star that a document joins first.
STARS = 4
#: Share of the union from which a comparison with a star's centre makes it a pivot. Of a group of near copies, those
#: with a pivot of their own would meet all others by prefixes, so even far ones shall keep the group's pivot.
NEAR = 0.3
#: Width of a bin of set sizes, as a factor.
SIZE_STEP = 1.02
#: Bits of the filter that spares documents outside all candidates (a proven bound: half a megabyte).
FILTER_BITS = 1 << 22


def prefix_base(n: int, num: int, den: int) -> int:
    """Tokens of an n-set of which a similar set shares one at least."""
    return n - -(-num * n // den) + 1


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each document (size, digest of its set, star keys), and rows of tokens a task saw repeatedly.

    Counted are the tokens of twice the prefix in hash order, in all documents.
    """
    factors = np.random.default_rng(7).integers(1, 1 << 62, STARS, dtype=np.int64) * 2 + 1

    def rows(batches):
        names = ["doc_id", "n", "digest", "stars", "token", "times"]
        pending, held = [], 0
        seen = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def merge():
            nonlocal seen, pending, held
            fresh, times = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            tokens, place = np.unique(np.concatenate([seen[0], fresh]), return_inverse=True)
            total = np.zeros(len(tokens), np.int64)
            np.add.at(total, place, np.concatenate([seen[1], times]))
            seen, pending, held = (tokens, total), [], 0
            if len(tokens) > 4_000_000:  # of so many, those seen once so far are counted anew
                keep = total > 1
                seen = tokens[keep], total[keep]

        for batch in pieces(batches, "text"):
            sizes, digests, keys = [], [], []
            for found in shingle_sets(batch.column("text"), k):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append([int((found * f).min()) for f in factors] if len(found) else [])
                part = found[: 2 * prefix_base(len(found), num, den)]
                pending.append(part)
                held += len(part)
            if held > 1_000_000:
                merge()
            size = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())],
                names,
            )
        merge()
        keep = seen[1] >= LOCAL_COUNT
        tokens, times = seen[0][keep], seen[1][keep]
        for s in range(0, len(tokens), 50_000):
            part = tokens[s : s + 50_000]
            size = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.list_(pa.int64())), pa.array(part), pa.array(times[s : s + 50_000])],
                names,
            )

    return docs.mapInArrow(rows, "doc_id long, n long, digest binary, stars array<long>, token long, times long")


def prefixes(docs: DataFrame, frequent, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, base and tokens: the longest prefix of each non-empty set, frequent tokens last, else by hash."""

    def rows(batches):
        last = frequent.value
        for batch in pieces(batches, "text"):
            ids, sizes, bases, tokens = [], [], [], []
            for doc, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k)):
                n = len(found)
                if not n:
                    continue
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                    found = np.concatenate([found[~late], found[late]])
                base = prefix_base(n, num, den)
                ids.append(doc)
                sizes.append(n)
                bases.append(base)
                tokens.append(found[: base + MOST_MATCHES - 1])
            if ids:
                offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bases, pa.int32()), lists], ["doc_id", "n", "base", "tokens"])

    return docs.mapInArrow(rows, "doc_id long, n long, base int, tokens array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and packed set of the documents in `ids`, and of few others.

    A bit filter of fixed size keeps most other documents from being hashed and shuffled; the join that follows
    is exact.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    wanted = ids.select(F.col("id").alias("doc_id")).select(place.alias("p")).distinct().toPandas()["p"].to_numpy()
    bits = np.zeros(FILTER_BITS, bool)
    bits[wanted] = True
    held = spark.sparkContext.broadcast(np.packbits(bits))

    def rows(batches):
        bits = np.unpackbits(held.value).view(bool)
        for batch in pieces(batches, "text"):
            keep = pa.array(bits[batch.column("p").to_numpy()])
            batch = batch.filter(keep)
            if batch.num_rows:
                packed = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["id", "packed"])

    return docs.select("doc_id", place.alias("p"), "text").mapInArrow(rows, "id long, packed binary")


def compared(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, *, keep_extra: bool = False) -> DataFrame:
    """a, b, size of b's set, shared, linked, extra of the pairs (a, b); `pairs` is read more than once.

    Linked are pairs of which den * intersection >= num * union. With `keep_extra` all pairs come back that share
    `NEAR` of their union, with what b has and a has not; else only linked pairs.
    """
    names = ["a", "b", "size", "shared", "linked", "extra"]

    def rows(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                if not keep_extra and den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - shared
                linked = den * shared >= num * union
                if linked or keep_extra and shared >= NEAR * union:
                    out.append((a, b, len(y), shared, linked, np.setdiff1d(y, x, assume_unique=True) if keep_extra else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, ids, k)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(rows, "a long, b long, size long, shared long, linked boolean, extra array<long>")


def star_pairs(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class under each of its star keys, and with the smallest one of that class."""
    keyed = classes.select("class", F.posexplode("stars").alias("which", "star"))
    least = keyed.groupBy("which", "star").agg(F.min("class").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    direct = store(keyed.join(least, ["which", "star"]).where("class <> a").select("a", F.col("class").alias("b")).distinct(), "stars")
    above = direct.groupBy(F.col("b").alias("middle")).agg(F.min("a").alias("top"))
    farther = direct.join(above, direct["a"] == above["middle"]).select(F.col("top").alias("a"), "b")
    return direct.unionByName(farther).distinct()


def within_clusters(members: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) among classes compared with the same pivot p, in different components.

    With x = |a and p|: what a and b share is at most min(x_a, x_b), if they share nothing outside p. So a similar
    pair shares a token that p lacks, or both x reach num / (num + den) of the sum of the sizes. The second bounds
    the partner's size by x; partners are looked up by bins of size, and of substituted copies none qualifies.
    """
    near = members.where("pivot <> class")
    tokens = near.select("pivot", "class", "component", F.explode("extra").alias("token"))
    mixed = tokens.groupBy("pivot", "token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("pivot", "token")
    tokens = tokens.join(mixed, ["pivot", "token"])
    a, b = tokens.alias("a"), tokens.alias("b")
    by_token = a.join(
        b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class"))
        & (F.col("a.component") != F.col("b.component")),
    ).select(F.col("a.class").alias("a"), F.col("b.class").alias("b"))

    step = math.log(SIZE_STEP)
    size_bin = lambda c: F.floor(F.ln(c) / step)
    rows = near.select("pivot", "class", "component", F.col("n").cast("double").alias("n"), (F.col("shared") * (num + den) / num - F.col("n")).alias("most"))
    low, high = F.col("n") * num / den, F.least("most", F.col("n"))
    asking = rows.where(high >= low * (1 - 1e-9)).withColumn("bin", F.explode(F.sequence(size_bin(low) - 1, size_bin(high) + 1)))
    a, b = asking.alias("a"), rows.withColumn("bin", size_bin(F.col("n"))).alias("b")
    slack = 1e-6
    by_size = a.join(
        b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.component") != F.col("b.component"))
        & (F.col("b.n") <= F.col("a.n")) & (F.col("b.n") <= F.col("a.most") + slack) & (F.col("a.n") <= F.col("b.most") + slack)
        & (F.col("b.n") * den >= F.col("a.n") * num),
    ).select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b"))
    return by_token.unionByName(by_size).where("a <> b")


def candidates(members: DataFrame, prefixed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes in different components that share enough prefix tokens.

    `members`: class, the component that stars gave it and its pivot; pairs of one pivot are left to
    `within_clusters`. A pair is asked for as many shared tokens as the smaller of its two numbers of matches says,
    within the prefixes lengthened for that number.
    """
    rows = prefixed.join(members, prefixed["doc_id"] == members["class"]).select(
        "class", "component", "pivot", prefixed["n"], "base", F.posexplode("tokens").alias("at", "token")
    )
    rows = rows.select("token", "class", "component", "pivot", "n", F.greatest(F.lit(1), F.col("at") - F.col("base") + 2).alias("need"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("pivot").alias("first"), F.max("pivot").alias("last"))
    shared = shared.where("low <> high AND first <> last").select("token", "df")
    postings = store(rows.join(shared, "token"), "postings")

    # estimated cost of asking for m matches: postings looked at, and at most their number / m to verify
    limit = F.ceil(F.col("n") * num / den)
    costs = [F.sum(F.when(F.col("need") <= m, F.col("df") - 1).otherwise(0)) for m in range(1, MOST_MATCHES + 1)]
    costs = [c * F.lit(1.0 + VERIFY_COST / m) for m, c in enumerate(costs, 1)]
    by_class = postings.groupBy("class", "n").agg(*[c.alias(f"c{m}") for m, c in enumerate(costs, 1)])
    options = [F.when(limit >= m, F.struct(F.col(f"c{m}").alias("cost"), F.lit(m).alias("m"))) for m in range(1, MOST_MATCHES + 1)]
    chosen = by_class.select("class", "n", F.array_min(F.array_compact(F.array(*options)))["m"].alias("matches"))
    used = postings.join(chosen, ["class", "n"]).where("need <= matches").select("token", "class", "component", "pivot", "n", "need", "matches")

    a, b = used.alias("a"), used.alias("b")
    asked = F.least("a.matches", "b.matches")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.component") != F.col("b.component"))
        & (F.col("a.pivot") != F.col("b.pivot")) & (low * den >= high * num) & (F.col("a.need") <= asked) & (F.col("b.need") <= asked),
    ).select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), asked.alias("asked"))
    return met.groupBy("a", "b", "asked").agg(F.count("*").alias("shared")).where("shared >= asked").select("a", "b")


def similar_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Documents linked by Jaccard similarity of their word-shingle sets, as components.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of `words`
    words, or a shorter text as one shingle. Two documents link when den * |intersection| >= num * |union|. Returns
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of `docs`.

    1. Documents with equal sets become one class. 2. Each class is compared with the smallest class under each of
    a few permutation minima; verified links join them, so large groups of near copies become one component at
    linear cost. 3. Adaptive prefix join for every link that is left: tokens in a global order (frequent ones last,
    else by hash), prefixes lengthened as far as the estimated cost of their candidates falls, pairs within one
    component never made, all others verified on their whole sets. The result is exact up to collisions of 64-bit
    hashes; the order, the stars and the estimates only change the time.

    A null or empty text, or one of white space, has 0 shingles and its own key as component. A null key has a null
    component and no links. Rows that repeat a key each get a row; they share a component if one of their texts has
    it. Extra columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = store(signatures(docs, words, num, den), "signatures")
    rows = signed.where("token IS NULL").select("doc_id", "n", "digest", "stars")
    counted = signed.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    top = counted.orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(top.astype(np.int64)))

    keyed = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = keyed.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "stars"), "doc_id").alias("r"))
    classes = store(classes.select("digest", F.col("r.doc_id").alias("class"), F.col("r.n").alias("n"), F.col("r.stars").alias("stars")), "classes")
    known = docs.where("doc_id IS NOT NULL")
    starred = store(compared(known, store(star_pairs(classes), "star-pairs"), words, num, den, keep_extra=True), "star-links")
    first = starred.where("linked").select("a", "b")
    near = connected(first)
    # of the classes that a class was compared with, the smallest one is its pivot
    pivots = starred.groupBy("b").agg(F.min_by(F.struct("a", "shared", "extra"), "a").alias("p"))
    members = classes.select("class", "n").join(near, classes["class"] == near["id"], "left").join(pivots, classes["class"] == pivots["b"], "left")
    members = members.select("class", "n", F.coalesce("component", "class").alias("component"), F.coalesce("p.a", "class").alias("pivot"), F.col("p.shared").alias("shared"), F.col("p.extra").alias("extra"))
    members = store(members, "members")
    across = candidates(members.select("class", "component", "pivot"), prefixes(known, frequent, words, num, den), num, den)
    pairs = store(across.unionByName(within_clusters(members, num, den)).distinct(), "candidates")
    links = first.unionByName(compared(known, pairs, words, num, den).select("a", "b"))

    # equal texts under different classes' keys, and repeated keys: every row links its key with its class
    same = keyed.join(classes.select("digest", "class"), "digest").select(F.col("doc_id").alias("a"), F.col("class").alias("b")).where("a <> b")
    final = connected(links.unionByName(same))
    return rows.join(final, rows["doc_id"] == final["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def similar_components_query(documents: DataFrame) -> DataFrame:
    return similar_components(documents)


def similar_components_sql(table: str = "documents", words: int = 3, num: int = 90, den: int = 100) -> str:
    """`similar_components` for DuckDB: shingles counted pair by pair, links followed to their smallest key."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {table}),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: list_aggregate(w[i:i + {words} - 1], 'string_agg', ' '))) END AS s
  FROM split),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM shingled),
tokens AS (SELECT doc_id, unnest(s) AS token FROM shingled),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE {den} * shared >= {num} * (p.n + q.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT sizes.doc_id, n AS n_shingles, min(other) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY ALL"""
