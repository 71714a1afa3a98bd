"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them, one kept per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import connected
from lectern.llm.shared import prepare, store

COSINE = 0.9
#: Vectors for each cell: fewer make more cells, and where dimensions are many a vector visits most of them, so each
#: cell costs copies. At most so many centres are sent to a task.
PER_CELL = 4096
MOST_CELLS = 2048
ROUNDS = 4
#: Added to the distance that decides on a visit: more than what rounding can take from it.
SLACK = 1e-8
#: Vectors in a tile; a task holds the product of two tiles. Hosts come in blocks of at most about 4 tiles, the
#: vectors that meet them in slices of about 8.
BLOCK = 2048


def lossless(cosine: float) -> float:
    """A vector also visits the cells whose boundary with its own lies nearer than this.

    A pair at this cosine is at most sqrt(2 - 2 cosine) apart, and of the two ways to the other's cell one takes at
    most half of it: one of the two visits the other, and no pair is lost.
    """
    return float(np.sqrt(2 - 2 * cosine) / 2)


def unit(packed, kind: str) -> np.ndarray:
    """Rows of unit length in double precision."""
    rows = np.stack([np.frombuffer(p, kind) for p in packed]).astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distances(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))


def fit_centres(vectors: DataFrame, n: int, per_cell: int, kind: str) -> np.ndarray:
    """Spherical k-means over all vectors; a round sends back one sum for each cell and dimension."""
    spark = vectors.sparkSession
    k = int(np.clip(round(n / per_cell), 1, MOST_CELLS))
    first = vectors.orderBy(F.xxhash64("cid"), "cid").limit(k).select("packed").toPandas()["packed"]
    centres = unit(first, kind)
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(centres)

        def sums(batches, held=held):
            centres = held.value
            total = np.zeros_like(centres)
            for batch in batches:
                if batch.num_rows:
                    x = unit(batch.column("packed").to_pylist(), kind)
                    np.add.at(total, (x @ centres.T).argmax(1), x)
            cell, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[cell, place])], ["cell", "place", "s"])

        got = vectors.select("packed").mapInArrow(sums, "cell long, place long, s double").groupBy("cell", "place").agg(F.sum("s").alias("s")).toPandas()
        total = np.zeros_like(centres)
        total[got["cell"], got["place"]] = got["s"]
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
        held.unpersist()
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray, margin: float, kind: str) -> DataFrame:
    """A row for each vector in its home cell, and for each cell that it visits; `visits` has a bit for each cell."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    names = ["cell", "home", "visits", "cid", "copies", "packed"]

    def rows(batches):
        centres = held.value
        gaps = distances(centres)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("packed").to_pylist(), kind)
            near = x @ centres.T
            own = near.argmax(1)
            beside = near[np.arange(len(x)), own][:, None] - near <= margin * gaps[own] + SLACK
            beside[np.arange(len(x)), own] = True
            row, cell = np.nonzero(beside)
            at = pa.array(row)
            visits = pa.array([bits.tobytes() for bits in np.packbits(beside, axis=1)], pa.binary()).take(at)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[row]), visits, *[batch.column(c).take(at) for c in names[3:]]], names)

    return vectors.select("cid", "copies", "packed").mapInArrow(rows, "cell long, home long, visits binary, cid long, copies long, packed binary")


def spanning(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the smallest row that it reaches."""
    label = np.arange(len(links))
    some = np.flatnonzero(links.any(1))
    links = links[np.ix_(some, some)]
    local = np.arange(len(some))
    while len(some):
        least = np.minimum(local, np.where(links, local[None, :], len(some)).min(1))
        least = np.minimum(least, least[least])
        if (least == local).all():
            break
        local = least
    label[some] = some[local]
    return label


def block_links(cosine: float, kind: str, tile: int):
    def compare(key, group):
        """Links of a block of a cell's own vectors with a slice of all that are in the cell: sums of copies for each
        vector, and a forest of links."""
        cell = key[0]
        hosts, others = group[group["host"]], group[~group["host"]]
        done = []
        for start in range(0, len(hosts), tile):
            host = hosts.iloc[start : start + tile]
            x, host_cid, host_copies = unit(host["packed"], kind), host["cid"].to_numpy(), host["copies"].to_numpy()
            visits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in host["visits"]]), axis=1)
            for begin in range(0, len(others), tile):
                other = others.iloc[begin : begin + tile]
                home, cid, copies = (other[c].to_numpy() for c in ("home", "cid", "copies"))
                a, b = np.nonzero(x @ unit(other["packed"], kind).T >= cosine)
                # a pair that meets in both homes counts where the number of the home is smaller
                again = (home[b] < cell) & (visits[a, home[b]] == 1)
                ok = (host_cid[a] != cid[b]) & ~again
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                # two of the cell's own meet twice, each once as the host
                guest = home[b] != cell
                ends = np.concatenate([host_cid[a], cid[b]])
                nodes, at = np.unique(ends, return_inverse=True)
                left, right = at[: len(a)], at[len(a) :]
                links = np.bincount(left, copies[b], len(nodes))
                links += np.bincount(right[guest], host_copies[a[guest]], len(nodes))
                linked = np.zeros((len(nodes), len(nodes)), bool)
                linked[left, right] = linked[right, left] = True
                done.append(pd.DataFrame({"cid": nodes, "root": nodes[spanning(linked)], "links": links.astype(np.int64)}))
        return pd.concat(done) if done else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("cid", "root", "links")})

    return compare


def dedup_embeddings(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, margin: float | None = None,
    per_cell: int = PER_CELL, block: int = BLOCK,
) -> DataFrame:
    """Vectors linked by cosine of at least `cosine`, in double precision: key, n_links, component_id, kept.

    Equal vectors become one class with a number of copies. Classes get a cell by spherical k-means fitted on all of
    them, and visit the cells near whose boundary they lie. A task multiplies a block of a cell's own vectors with a
    slice of all that are in the cell, adds up links and keeps a spanning forest of them, so pairs are never rows.
    No pair is missed (see `lossless`), unless a smaller `margin` is asked for.

    Null vectors, zero vectors and those with a null or non-finite component link with nothing and are their own
    component; so are rows with a null key, whose component is null and who are not kept. Vectors link only with
    those of equal length. Repeated rows count as vectors of their own: n_links counts rows, component_id is the
    smallest key, and each row with that key is kept. Extra columns are not read. An empty table gives an empty table.
    """
    spark = df.sparkSession
    prepare(spark)
    margin = lossless(cosine) if margin is None else margin
    element = df.schema[vector].dataType.elementType
    kind, word = ("f4", "float") if isinstance(element, (T.FloatType, T.ByteType, T.ShortType)) else ("f8", "double")
    v = F.col("_v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("_k"), F.col(vector).cast(f"array<{word}>").alias("_v"))
    # equal vectors have equal text; 0 and -0 are one
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0).cast(word)))
    rows = rows.withColumn("_d", F.when(good & F.col("_k").isNotNull(), F.md5(F.col("_v").cast("string").cast("binary"))))
    classes = rows.where("_d IS NOT NULL").groupBy("_d").agg(F.min("_k").alias("least"), F.count("*").alias("copies"), F.first("_v").alias("_v"))

    def pack(batches):
        for batch in batches:
            lists = batch.column("_v")
            packed = [np.asarray(x.values, kind).tobytes() for x in lists]
            sizes = pa.array([len(x) for x in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_d", "least", "copies")], sizes, pa.array(packed, pa.binary())], ["_d", "least", "copies", "dim", "packed"])

    classes = classes.mapInArrow(pack, "_d string, least long, copies long, dim int, packed binary")
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        mine = classes.where(F.col("dim") == dim)
        centres = fit_centres(mine, n, per_cell, kind)
        placed = store(assigned(mine, centres, margin, kind), "cells")
        own = F.col("home") == F.col("cell")
        parts = [F.ceil(F.count_if(own) / (4 * block)).cast("long").alias("blocks"), F.ceil(F.count("*") / (8 * block)).cast("long").alias("slices")]
        sizes = placed.groupBy("cell").agg(*parts).where("blocks > 0")
        dealt = placed.join(F.broadcast(sizes), "cell")  # one row for each of at most MOST_CELLS cells
        block_no, slice_no = (F.pmod(F.xxhash64("cid"), F.col(c)) for c in ("blocks", "slices"))
        every = {c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("blocks", "slices")}
        columns = ["cell", "home", "visits", "cid", "copies", "packed"]
        hosts = dealt.where(own).select(*columns, F.lit(True).alias("host"), block_no.alias("i"), every["slices"].alias("j"))
        others = dealt.select(*columns, F.lit(False).alias("host"), every["blocks"].alias("i"), slice_no.alias("j"))
        compare = block_links(cosine, kind, block)
        some = hosts.unionByName(others).groupBy("cell", "i", "j").applyInPandas(compare, "cid long, root long, links long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "cid long, root long, links long")
    found = store(found, "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    named = classes.select("_d", "least", "copies", "cid").join(counts, "cid", "left").join(groups, "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("_d", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("_k", "_d").join(named, "_d", "left").select(
        F.col("_k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_k").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def dedup_embeddings_sql() -> str:
    """`dedup_embeddings` on `embeddings` for DuckDB, by comparing all pairs."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY ALL),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY ALL)
SELECT vec_id, COALESCE(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM groups LEFT JOIN counts USING (vec_id)"""
