"""Exact cosine search within scopes: blocks of near vectors, skipped by centre and radius."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions.common import top_rows
from lectern.session import ship_package

#: Numbers in a block of vectors (of wide ones their first 64 count), and queries in a pack.
BLOCK_FLOATS, PACK_ROWS = 8192, 256
#: Shares of a scope's blocks, each of which meets the scope's packs in tasks of its own.
SHARES = 8
#: Best rows that a task holds before it hands them on.
HELD_ROWS = 2_000_000
DIGITS = 4
SCOPE = {"course_id": "want_course", "chapter_num": "want_chapter"}


def unit_rows(rows) -> np.ndarray:
    matrix = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def near_blocks(matrix: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in blocks of at most `most`: halved at the median of the widest dimension, so that a block's rows are near."""
    done, open_ = [], [np.arange(len(matrix))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        widest = np.argmax(matrix[rows].var(axis=0))
        ordered = rows[np.argsort(matrix[rows, widest], kind="stable")]
        open_ += [ordered[: len(rows) // 2], ordered[len(rows) // 2 :]]
    return done


def vector_blocks(vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Blocks of at most 8,192 numbers, or 128 wide rows, of unit vectors of one tenant, course and chapter, with their centre and radius.

    Rows are dealt by scope; partitions that a large scope fills are split by adaptive execution.
    """
    scope = ["user_id", *[c for c in SCOPE if c in vectors.columns]]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            batch = batch.assign(dim=batch["embedding"].map(len))
            for where, rows in batch.groupby([*scope, "dim"], sort=False, dropna=False):
                unit, ids = unit_rows(rows["embedding"]), rows[id_col].to_numpy(dtype=np.int64)
                for block in near_blocks(unit, max(8, BLOCK_FLOATS // min(max(unit.shape[1], 1), 64))):
                    centre = unit[block].mean(axis=0)
                    radius = float(np.linalg.norm(unit[block] - centre, axis=1).max())
                    out.append((*where, ids[block].tobytes(), unit[block].tobytes(), centre.tobytes(), radius))
            if out:
                yield pd.DataFrame(out, columns=[*scope, "dim", "b_ids", "b_vectors", "centre", "radius"]).astype({c: object for c in scope})

    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*scope, id_col, "embedding").hint("rebalance", *scope)
    schema = ", ".join(f"{c} {kinds[c]}" for c in scope) + ", dim int, b_ids binary, b_vectors binary, centre binary, radius double"
    return rows.mapInPandas(pack, schema)


def query_packs(queries: DataFrame, key: list[str]) -> DataFrame:
    """Packs of up to 256 queries of one tenant and scope; `key` is user_id and whole numbers. Zero vectors drop out."""
    scope = ["user_id", *[w for w in SCOPE.values() if w in queries.columns]]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            batch = batch.assign(dim=batch["embedding"].map(len))
            for where, rows in batch.groupby([*scope, "dim"], sort=False, dropna=False):
                unit, keys = unit_rows(rows["embedding"]), rows[key[1:]].to_numpy(dtype=np.int64)
                live = np.flatnonzero(np.abs(unit).sum(axis=1) > 0)
                for at in range(0, len(live), PACK_ROWS):
                    some = live[at : at + PACK_ROWS]
                    out.append((*where, keys[some].tobytes(), unit[some].tobytes()))
            if out:
                frame = pd.DataFrame(out, columns=[*scope, "dim", "q_keys", "q_vectors"]).astype({c: object for c in scope})
                yield frame.where(frame.notna(), None)

    rows = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*key, *scope[1:], "embedding")
    return rows.mapInPandas(pack, ", ".join(f"{c} {kinds[c]}" for c in scope) + ", dim int, q_keys binary, q_vectors binary")


def in_scope(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Packs beside the blocks of their scope; an absent limit fits every course or chapter.

    Each combination of limits is an equi-join of its own, so a scoped query never meets another scope's blocks. Blocks are
    dealt in shares and packs go to each, so a tenant is not one task.
    """
    wanted = [(have, want) for have, want in SCOPE.items() if want in packs.columns]
    blocks = blocks.withColumn("share", F.pmod(F.xxhash64("b_ids"), F.lit(SHARES)))
    packs = packs.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    out = None
    for mask in range(1 << len(wanted)):
        some, on = packs, (F.col("q.user_id") == F.col("b.user_id")) & (F.col("q.dim") == F.col("b.dim")) & (F.col("q.share") == F.col("b.share"))
        for bit, (have, want) in enumerate(wanted):
            limited = bool(mask >> bit & 1)
            some = some.where(F.col(want).isNotNull() if limited else F.col(want).isNull())
            if limited:
                on &= F.col(f"q.{want}") == F.col(f"b.{have}")
        pairs = some.alias("q").join(blocks.alias("b"), on).select("q.user_id", "q.dim", "q_keys", "q_vectors", "b_ids", "b_vectors", "centre", "radius")
        out = pairs if out is None else out.unionByName(pairs)
    return out


class Best:
    """The best `k` rows so far of each query of a pack, by rounded score, ties by id."""

    def __init__(self, user, keys: np.ndarray, unit: np.ndarray, k: int):
        self.user, self.keys, self.unit, self.k = user, keys, unit, k
        self.scores, self.ids = np.full((len(unit), k), -np.inf), np.full((len(unit), k), np.iinfo(np.int64).max)
        self.met = self.skipped = 0

    def meet(self, ids: np.ndarray, unit: np.ndarray, centre: np.ndarray, radius: float) -> None:
        """Unit vectors of a block score at most query . centre + radius: below a query's last row they can't enter."""
        reach = np.round(self.unit @ centre + radius + 1e-9, DIGITS) + 10.0**-DIGITS
        live = np.flatnonzero(reach >= self.scores[:, -1])
        self.met += len(live)
        self.skipped += len(self.unit) - len(live)
        if not len(live):
            return
        fresh = np.round(self.unit[live] @ unit.T, DIGITS) + 0.0
        # only queries and vectors with a score that can enter a list are put in order
        enters = fresh >= self.scores[live, -1:]
        some, columns = np.flatnonzero(enters.any(axis=1)), np.flatnonzero(enters.any(axis=0))
        if not len(some):
            return
        live, fresh = live[some], fresh[np.ix_(some, columns)]
        scores = np.concatenate([self.scores[live], fresh], axis=1)
        names = np.concatenate([self.ids[live], np.broadcast_to(ids[columns], fresh.shape)], axis=1)
        order = np.lexsort((names, -scores), axis=-1)[:, : self.k]
        self.scores[live], self.ids[live] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def rows(self, key: list[str]) -> pd.DataFrame:
        at, place = np.nonzero(np.isfinite(self.scores))
        columns = {c: self.keys[at, n] for n, c in enumerate(key[1:])}
        return pd.DataFrame({key[0]: self.user, **columns, "chunk_id": self.ids[at, place], "score": self.scores[at, place]})


def search_pairs(batches: Iterable[pd.DataFrame], key: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Best rows of each query among the blocks that one task sees; the most promising blocks of a batch come first."""
    held: dict[tuple, Best] = {}
    for batch in batches:
        packs: dict[tuple, list] = {}
        for row in batch.itertuples(index=False):
            packs.setdefault((row.user_id, row.q_keys), []).append(row)
        for name, rows in packs.items():
            if name not in held:
                keys = np.frombuffer(name[1], np.int64).reshape(-1, len(key) - 1)
                held[name] = Best(name[0], keys, np.frombuffer(rows[0].q_vectors).reshape(len(keys), -1), k)
            best = held[name]
            centres = np.stack([np.frombuffer(r.centre) for r in rows])
            promise = (best.unit @ centres.T).max(axis=0) + np.array([r.radius for r in rows])
            for i in np.argsort(-promise, kind="stable"):
                ids = np.frombuffer(rows[i].b_ids, np.int64)
                best.meet(ids, np.frombuffer(rows[i].b_vectors).reshape(len(ids), -1), centres[i], rows[i].radius)
        if sum(b.scores.size for b in held.values()) > HELD_ROWS:
            yield pd.concat([b.rows(key) for b in held.values()])
            held = {}
    if held:
        yield pd.concat([b.rows(key) for b in held.values()])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = V.DENSE_TOP_K, key: list[str] | None = None) -> DataFrame:
    """(key, chunk_id, score, rank): exact cosine top-k of every query among its tenant's vectors.

    Columns want_course and want_chapter of the queries, where present and not null, limit a query to vectors of that
    course_id and chapter_num; the limit holds before the top-k cut. Packs of queries meet blocks of vectors by equi-joins,
    so one joined row is a block product; blocks that can't reach a query's running top-k are skipped. Only the best rows
    of each task are shuffled. Null and empty vectors take no part, zero queries find nothing.
    """
    ship_package(queries.sparkSession)
    key = key or ["user_id", "q_id"]
    pairs = in_scope(query_packs(queries, key), vector_blocks(vectors))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    schema = ", ".join(f"{c} {kinds[c] if c == key[0] else 'bigint'}" for c in key) + ", chunk_id bigint, score double"
    scored = pairs.mapInPandas(lambda batches: search_pairs(batches, key, k), schema)
    scored = scored.select(*[F.col(c).cast(kinds[c]).alias(c) for c in key], "chunk_id", "score")
    return top_rows(scored, key, [F.desc("score"), F.asc("chunk_id")], k)
