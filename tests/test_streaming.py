"""Streams over several files, the latest times first, against the same job on one batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs as L

SCHEMA = """user_id string, course_id string, file_hash string, question_id long, chapter_ref string, kind string, ts timestamp, ran_at timestamp,
refused boolean, latency_ms long, job_id string, file_id long, stage string, pages_done long, seq long, correct boolean"""


def rows(month):
    at = datetime(2024, 1, 1) + timedelta(days=60 * month)
    out = []
    for i in range(8):
        ts = at + timedelta(minutes=25 * i)
        out.append(("u1", "c", f"h{i % 3}", i % 5 + 3 * (month // 2), "c1", "question", ts, ts, i % 2 == 0, i, "j", i % 2, f"s{month}", i, i, i % 2 == 0))
    return out


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "source")
    for month in (3, 2, 1, 0):
        spark.createDataFrame(rows(month), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    # the odd attempts come first and make sessions of their own, the even ones bridge them later
    later = datetime(2025, 1, 1)
    for odd in (1, 0):
        bridge = [("u2", "c", "h9", 1, "c2", "export", later + timedelta(minutes=25 * i), later, True, 1, "j", 9, "z", 1, i, True) for i in range(odd, 8, 2)]
        spark.createDataFrame(bridge, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def jobs(spark, batch):
    known = batch.where("file_hash = 'h0'")
    return {
        "engagement": L.engagement(), "progress": L.job_progress(), "dedupe": L.ingest_dedupe(known), "windows": L.run_windows(),
        "sliding": L.run_windows("2 days", "1 day"), "sessions": L.sessions(),
    }


@pytest.mark.parametrize("name", ["engagement", "progress", "dedupe", "windows", "sliding", "sessions"])
def test_late_files_equal_one_batch_without_state(spark, source, tmp_path, monkeypatch, name):
    monkeypatch.setattr(L, "COMPACT_EVERY", 2)  # snapshots in between
    batch = spark.read.schema(SCHEMA).parquet(source)
    job = jobs(spark, batch)[name]
    # a file a batch, in the order in which they were written
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = L.run_job(stream, job, f"{tmp_path}/sums", f"{tmp_path}/state")
    query.awaitTermination()
    assert len(query.recentProgress) >= 6 and all(not p["stateOperators"] for p in query.recentProgress)
    assert same(L.report(stream, job, f"{tmp_path}/sums"), job.batch(batch))
    # the last batch, the second file of u2, is run again with the same number, and so is the snapshot after it
    again = batch.where("user_id = 'u2' AND seq % 2 = 0")
    assert again.count() == 4
    L.save_batch(job, again, 5, f"{tmp_path}/sums", L._schema(job, stream).schema)
    assert same(L.report(stream, job, f"{tmp_path}/sums"), job.batch(batch))


def test_a_late_attempt_joins_two_sessions(spark, source):
    batch = spark.read.schema(SCHEMA).parquet(source)
    spans = L.sessions().batch(batch.where("user_id = 'u2'")).collect()
    assert len(spans) == 1 and spans[0].n == 8
    assert L.sessions().batch(batch.where("user_id = 'u2' AND seq % 2 = 1")).count() == 4
