"""Incremental forms of the counters, progress, dedupe, monitoring and session jobs.

A job is three functions: `partial` sums up one batch of rows, `merge` combines such sums in any order and grouping, and
`finish` reads the report off. The stream itself keeps no state: each batch writes its sums to a folder of its own, so a
batch that is repeated after a failure changes nothing, and every few batches all sums are merged into one snapshot.
There is no watermark, so nothing is too late; what grows with the number of keys is the table, not a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.common import ratio

SESSION_GAP = "30 minutes"
#: Batches whose sums are merged into one snapshot.
COMPACT_EVERY = 8


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stream over the parquet files of one table; its timestamps become zoned."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    naive = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


@dataclass(frozen=True)
class Job:
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]

    def batch(self, rows: DataFrame) -> DataFrame:
        """The report on a whole table."""
        return self.finish(self.merge(self.partial(rows)))


# --- jobs -----------------------------------------------------------------------------------


def engagement() -> Job:
    """Counters per user and chapter; one question counts once per chapter, by its first kind, however late it is repeated.

    Rows: user_id, question_id, chapter_ref, kind, ts.
    """
    key = ["user_id", "question_id", "chapter_ref"]

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min(F.struct("ts", "kind")).alias("first")).select(*key, "first.ts", "first.kind")

    def finish(rows: DataFrame) -> DataFrame:
        kinds = {"questions": "question", "ps_hits": "ps_hit", "exports": "export"}
        return rows.groupBy("user_id", "chapter_ref").agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()])

    return Job(first, first, finish)


def job_progress() -> Job:
    """Latest stage and furthest page per job and file. Rows: job_id, file_id, stage, pages_done, ts, seq."""
    key = ["job_id", "file_id"]

    def partial(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("ts", "seq", "stage")).alias("last")
        return rows.groupBy(*key).agg(last, F.max("pages_done").alias("pages_done"), F.count("*").alias("n_patches"))

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.max("last").alias("last"), F.max("pages_done").alias("pages_done"), F.sum("n_patches").alias("n_patches"))

    return Job(partial, merge, lambda rows: rows.select(*key, F.col("last.stage").alias("stage"), "pages_done", "n_patches"))


def ingest_dedupe(known: DataFrame) -> Job:
    """New files per course: not in `known`, and each once however often it comes. Rows: user_id, course_id, file_hash."""
    key = ["user_id", "course_id", "file_hash"]
    fresh = lambda rows: rows.select(*key).distinct().join(known.select(*key), key, "left_anti")
    return Job(fresh, lambda rows: rows.distinct(), lambda rows: rows)


def run_windows(width: str = "1 day", slide: str | None = None) -> Job:
    """Answered, refused and latency per time window of the run log. Rows: ran_at, refused, latency_ms."""

    def partial(rows: DataFrame) -> DataFrame:
        window = F.window("ran_at", width, slide) if slide else F.window("ran_at", width)
        return rows.groupBy(window.alias("w")).agg(
            F.count("*").alias("n"), F.count_if("refused").alias("refused_n"),
            F.sum("latency_ms").alias("latency_total"), F.max("latency_ms").alias("latency_max"),
        )

    def merge(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("n", "refused_n", "latency_total")]
        return rows.groupBy("w").agg(*sums, F.max("latency_max").alias("latency_max"))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "refused_n",
            F.round(ratio(F.col("latency_total"), F.col("n")), 4).alias("latency_mean"), "latency_max",
        )

    return Job(partial, merge, finish)


def sessions(gap: str = SESSION_GAP) -> Job:
    """Study sessions: attempts of a user with at most `gap` between them. Rows: user_id, ts, correct.

    A batch's sessions are spans; merging joins spans that overlap or lie within the gap, so an attempt that comes late
    and bridges two finished sessions makes them one.
    """
    open_until = F.expr(f"last + INTERVAL {gap}")

    def partial(rows: DataFrame) -> DataFrame:
        sums = [F.count("*").alias("n"), F.count_if("correct").alias("n_correct")]
        return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), *sums).drop("s")

    def merge(rows: DataFrame) -> DataFrame:
        ordered = Window.partitionBy("user_id").orderBy("start", "last")
        before = F.max(open_until).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
        numbered = rows.withColumn("begins", begins).withColumn("no", F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        spans = numbered.groupBy("user_id", "no").agg(
            F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct")
        )
        return spans.drop("no")

    return Job(partial, merge, lambda rows: rows.select("user_id", "start", open_until.alias("end"), "n", "n_correct"))


# --- the table of sums --------------------------------------------------------------------------


def sums_so_far(spark: SparkSession, job: Job, folder: str, schema, upto: int | None = None) -> DataFrame:
    """All sums, those of the last snapshot and of the batches after it, up to batch `upto`, merged."""
    typed = schema.add("batch", "long") if "batch" not in schema.names else schema
    base = spark.createDataFrame([], typed)
    for kind in ("snapshots", "parts"):
        table = spark.read.schema(typed).option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}")
        if kind == "snapshots":
            table = table if upto is None else table.where(F.col("batch") < upto)  # a repeated batch writes its snapshot anew
            last = table.agg(F.max("batch")).first()[0]
            base = base if last is None else table.where(F.col("batch") == last)
        else:
            late = table if last is None else table.where(F.col("batch") > last)
            base = base.unionByName(late if upto is None else late.where(F.col("batch") <= upto))
    return job.merge(base.drop("batch"))


def run_job(stream: DataFrame, job: Job, folder: str, state: str) -> StreamingQuery:
    """Run `job` over all available input. Every batch overwrites its own part; every COMPACT_EVERY-th one a snapshot too."""
    spark = stream.sparkSession
    for kind in ("snapshots", "parts"):  # empty tables, so that they can be read before the first batch
        _schema(job, stream).write.mode("ignore").parquet(f"{folder}/{kind}/batch=-1")

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
        lambda rows, batch: save_batch(job, rows, batch, folder, _schema(job, stream).schema)
    ).start()


def save_batch(job: Job, rows: DataFrame, batch: int, folder: str, schema) -> None:
    """Write the sums of one batch, and the snapshot that is due after it; a second time changes nothing."""
    job.partial(rows).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch}")
    if (batch + 1) % COMPACT_EVERY == 0:
        sums_so_far(rows.sparkSession, job, folder, schema, batch).write.mode("overwrite").parquet(f"{folder}/snapshots/batch={batch}")


def _schema(job: Job, stream: DataFrame) -> DataFrame:
    """An empty table with the columns of the job's sums."""
    return job.partial(stream.sparkSession.createDataFrame([], stream.schema))


def report(stream: DataFrame, job: Job, folder: str) -> DataFrame:
    """The job's report on everything its stream has handled."""
    return job.finish(sums_so_far(stream.sparkSession, job, folder, _schema(job, stream).schema))
