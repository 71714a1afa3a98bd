"""Hard negatives by threshold joins: an index without what norm bounds cover, thresholds lowered until windows fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.common import top_rows
from lectern.llm.shared import prepare, store

#: Vectors are compared after floor(SCALE * x).
SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between LOW and HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
#: Anchors and rows that meet in one task at most, on average.
ANCHOR_BLOCK, ROW_BLOCK = 1024, 8192
#: Dimensions whose partial scores are added between two prunings.
STEP = 8
#: Thresholds for positives, as shares of the largest product that norms allow; the last finds every score from 0 on.
POSITIVE_LEVELS = (0.6, 0.4, 0.25, 0.1, 0.0)
#: Thresholds for negatives, as shares of the positive's score; the last is the end of the window.
NEGATIVE_LEVELS = (0.85, 0.7, LOW / 100)
#: Vectors of a larger norm have products beyond a long and take no part.
MOST_NORM = 3.0e9


def exact_norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(-1))


def reaching(q: np.ndarray, x: np.ndarray, least: np.ndarray):
    """(anchor, row, product) of all pairs of `q` and `x` whose inner product is at least the anchor's `least`.

    Dimensions are taken by falling energy. A row's postings end where its suffix norm times the largest anchor norm falls
    below the lowest threshold: what comes later is covered by that bound. Partial scores are accumulated over the
    postings, a few dimensions at a time; a pair goes when its partial score and the product of the remaining norms
    stay below the anchor's threshold, and a row when no anchor is left for it. What is left gets its exact product.
    Whole numbers in, whole numbers out: products are exact in doubles below 2^53, and in long integers beyond.
    """
    none = np.zeros(0, np.int64)
    if not len(q) or not len(x):
        return none, none, none
    q_size, x_size = exact_norm(q), exact_norm(x)
    number = np.float64 if q_size.max() * x_size.max() < 2**52 else np.int64
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    q, x = q[:, order].astype(number), x[:, order].astype(number)
    dim = x.shape[1]

    def suffixes(v):
        squares = v.astype(np.float64) ** 2
        return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])

    slack = lambda bound: bound * (1 + 1e-9) + 1e-6  # noqa: E731  more than rounding can take
    q_rest, x_rest = suffixes(q), suffixes(x)
    ends = (slack(x_rest * q_size.max()) >= least.min()).sum(1)  # the postings of a row: its dimensions before this one
    at = np.argsort(-ends, kind="stable")
    at = at[: int((ends > 0).sum())] if least.min() > 0 else at
    x, x_rest, ends = x[at], x_rest[at], ends[at]
    score = np.zeros((len(q), len(x)), number)
    for start in range(0, dim, STEP):
        stop = min(start + STEP, dim)
        held = int(np.searchsorted(-ends, -start, side="left"))  # rows with postings here
        if not held:
            break
        # a row whose postings end inside the step keeps the step's other dimensions too: less to bound, as exact
        score[:, :held] += q[:, start:stop] @ x[:held, start:stop].T
        if stop < dim:
            bound = q_rest[:, stop, None] * x_rest[None, :, stop]
            if held < len(x):
                done = -(-ends[held:] // STEP) * STEP  # where the accumulation of these rows has ended
                done = np.minimum(done, dim - 1)
                bound[:, held:] = q_rest[:, done] * x_rest[np.arange(held, len(x)), done]
            alive = (score + slack(bound) >= least[:, None]).any(0)
            if alive.sum() < 0.8 * len(x):
                at, x, x_rest, ends, score = at[alive], x[alive], x_rest[alive], ends[alive], score[:, alive]
    product = q @ x.T
    a, r = np.nonzero(product >= least[:, None])
    return a, at[r], product[a, r].astype(np.int64)


def vectors_of(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows that take part: vec_id, label, dim, whole-number components as bytes; equal rows once."""
    v, whole = F.col("_v"), F.col("_w")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("_v"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST_NORM / SCALE))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND _v IS NOT NULL").where(usable)
    rows = rows.select("vec_id", "label", F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("_w"))
    rows = rows.where(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x.cast("double") * x) < MOST_NORM**2)
    return rows.withColumn("dim", F.size("_w"))


def packed(rows: DataFrame) -> DataFrame:
    """The components as bytes of 64-bit integers, and each row once."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("_w")
            raw = pa.array([np.asarray(x.values, np.int64).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "dim")] + [raw], ["vec_id", "label", "dim", "packed"])

    return rows.mapInArrow(pack, "vec_id long, label long, dim int, packed binary").distinct()


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["packed"]), np.int64).reshape(len(frame), -1)


def best(frame: pd.DataFrame, by: list[str], score: str, n: int) -> pd.DataFrame:
    ordered = frame.sort_values([*by, score, "vec_id"], ascending=[*[True] * len(by), False, True])
    return ordered.groupby(by, sort=False).head(n)


def meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, compare, schema: str) -> DataFrame:
    """`compare(anchors, rows)` for all blocks: each block of anchors meets each block of rows of its dimension once."""
    wide, tall = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("_n"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("i", block(wide)).withColumn("j", every(tall))
    right = rows.withColumn("j", block(tall)).withColumn("i", every(wide))
    keys = ["dim", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def find_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each anchor the first rows of its label whose score reaches its threshold, as far as this block has them."""
    columns = ["a", "vec_id", "score"]
    found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})]
    for label, mine in left.groupby("label", sort=False):
        others = right[right["label"] == label]
        if not len(others):
            continue
        a, r, score = reaching(matrix(mine), matrix(others), mine["least"].to_numpy())
        number, name = mine["_n"].to_numpy(), others["_n"].to_numpy()
        ok = number[a] != name[r]
        found.append(pd.DataFrame({"a": number[a][ok], "vec_id": others["vec_id"].to_numpy()[r[ok]], "score": score[ok]}))
    return best(pd.concat(found), ["a"], "score", POSITIVES)[columns]


def find_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each open window of each anchor the first rows of other labels in it that reach the anchor's threshold."""
    columns = ["a", "no", "vec_id", "score"]
    found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})]
    if len(left) and len(right):
        windows = left[["_n", "label", "packed", "nos", "scores", "least"]]
        a, r, score = reaching(matrix(windows), matrix(right), windows["least"].to_numpy())
        other = windows["label"].to_numpy()[a] != right["label"].to_numpy()[r]
        a, r, score = a[other], r[other], score[other]
        number, name = windows["_n"].to_numpy(), right["vec_id"].to_numpy()
        nos, scores = list(windows["nos"]), list(windows["scores"])
        most = max(map(len, nos))
        for k in range(most):  # the windows of an anchor, the first, the second, ...
            no = np.array([n[k] if k < len(n) else -1 for n in nos], np.int64)
            p = np.array([s[k] if k < len(s) else -1 for s in scores], np.int64)
            ok = (no[a] >= 0) & (LOW * p[a] <= 100 * score) & (100 * score <= HIGH * p[a])
            frame = pd.DataFrame({"a": number[a[ok]], "no": no[a[ok]], "vec_id": name[r[ok]], "score": score[ok]})
            found.append(best(frame, ["a", "no"], "score", NEGATIVES))
    return pd.concat(found)[columns]


def mine_negatives(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchor_every: int = ANCHOR_EVERY,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x), a score is the inner product with the anchor, higher first and ties by smaller key.
    Anchors are rows whose key is divisible by `anchor_every`; their positives are the first 5 other rows of their label.
    For each anchor and positive: the first 3 rows of other labels whose score is 50 to 95 hundredths of the positive's.

    Two threshold joins (see `reaching`). Positives: the threshold of an anchor falls level by level until 5 rows of its
    label reach it; all rows above a threshold are found, so these 5 are the first ones. Positives below zero have no
    negatives, so 0 is the last level. Negatives: the threshold falls until each window holds 3 rows, or to the window's
    end. Each level takes only the anchors that are still open.

    Rows with a null key, label or vector, or a null or non-finite component, take no part, nor do vectors of a norm
    from 3e9 on after scaling, whose products exceed a long. Vectors of different length don't meet. Equal rows count
    once; rows that share a key but differ are rows of their own. Extra columns are not read. An empty table, or one
    without anchors, gives an empty table.
    """
    prepare(df.sparkSession)
    return mined(vectors_of(df, key, vector, label), anchor_every)


def mined(rows: DataFrame, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    rows = store(packed(rows).withColumn("_n", F.monotonically_increasing_id()), "vectors")
    is_anchor = F.pmod("vec_id", F.lit(anchor_every)) == 0
    size = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).collect()}
    n_rows = max([0, *(r["n"] for r in size.values())])

    def norms(batches):
        for batch in batches:
            values = [float(exact_norm(np.frombuffer(v, np.int64))) for v in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "size"])

    sized = rows.mapInArrow(norms, "vec_id long, label long, dim int, packed binary, _n long, size double")
    largest = sized.groupBy("dim").agg(F.max("size").alias("largest"))  # one row for each dimension
    anchors = store(sized.where(is_anchor).join(largest, "dim").withColumn("most", F.col("size") * F.col("largest")), "anchors")

    positives, still = None, anchors
    for level in POSITIVE_LEVELS:
        n_open = still.count()
        if not n_open:
            break
        asked = still.withColumn("least", F.ceil(F.col("most") * level).cast("long")).select("dim", "label", "packed", "_n", "least")
        found = meet(asked, rows, n_open, n_rows, find_positives, "a long, vec_id long, score long")
        found = store(top_rows(found, ["a"], [F.desc("score"), F.asc("vec_id")], POSITIVES), "positives")
        full = found.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= POSITIVES)
        done = found.join(full, "a", "left_semi") if level else found
        positives = done if positives is None else positives.unionByName(done)
        still = store(still.join(full, still["_n"] == full["a"], "left_anti"), "open")
    empty = rows.sparkSession.createDataFrame([], "a long, vec_id long, score long, rank int")
    positives = empty if positives is None else positives
    positives = positives.select("a", F.col("rank").cast("int").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = store(positives.where("positive_score >= 0"), "positives")

    negatives, windows = None, positives.select("a", "no", "positive_score")
    for level in NEGATIVE_LEVELS:
        wanted = windows.groupBy("a").agg(
            F.collect_list("no").alias("nos"), F.collect_list("positive_score").alias("scores"), F.min("positive_score").alias("p")
        )
        asked = anchors.join(wanted, anchors["_n"] == wanted["a"]).withColumn("least", F.floor(F.col("p") * level).cast("long"))
        asked = store(asked.select("dim", "label", "packed", "_n", "nos", "scores", "least"), "asked")
        n_open = asked.count()
        if not n_open:
            break
        found = meet(asked, rows, n_open, n_rows, find_negatives, "a long, no int, vec_id long, score long")
        found = store(top_rows(found, ["a", "no"], [F.desc("score"), F.asc("vec_id")], NEGATIVES), "negatives")
        full = found.groupBy("a", "no").agg(F.count("*").alias("n")).where(F.col("n") >= NEGATIVES)
        last = level == NEGATIVE_LEVELS[-1]
        done = found if last else found.join(full, ["a", "no"], "left_semi")
        negatives = done if negatives is None else negatives.unionByName(done)
        windows = store(windows.join(full, ["a", "no"], "left_anti"), "windows")
    if negatives is None:
        negatives = rows.sparkSession.createDataFrame([], "a long, no int, vec_id long, score long, rank int")
    named = anchors.select(F.col("_n").alias("a"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["a", "no"]).join(named, "a").select(
        "anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def mine_negatives_query(embeddings: DataFrame) -> DataFrame:
    """`mine_negatives` after every seventh key has got the next label, so that some labels are wrong."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(embeddings.withColumn("label", moved))


def mine_negatives_sql(embeddings: str = "embeddings") -> str:
    """`mine_negatives_query` for DuckDB, by scoring every row for every anchor."""
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM {embeddings} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT row_number() OVER () AS n, * FROM v),
s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM n a JOIN n b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.n <> b.n AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS no FROM s WHERE same) x WHERE no <= {POSITIVES}),
g AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.no ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= {NEGATIVES}"""
