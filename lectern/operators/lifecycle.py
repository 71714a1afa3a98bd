"""Tenant-scoped data lifecycle: upserts, replacement, deletion with preview, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.common import first_row, matches
from lectern.session import cut_lineage

# --- deletion scopes: fixed values -----------------------------------------------------
SCOPES = ["materials", "syllabus", "assessment_uploads", "entire_course"]
MATERIAL_TYPES = ["textbook", "slides", "notes", "bbplus"]
SYLLABUS_FILE = "syllabus|course_outline|course-outline|syll"
SYLLABUS_NOTE = "from syllabus"
PROTECTED_TENANT = "benchmark"


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: str, preserved: Sequence[str] = ()) -> DataFrame:
    """`base` after keyed updates: the last update of a key wins as a whole, its nulls clear the stored value.

    Columns in `preserved` keep the stored value of existing rows.
    """
    keys = list(keys)
    columns = [c for c in base.columns if c not in keys]
    last = first_row(updates, keys, [F.desc(order)]).select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = base.withColumn("_old", F.lit(True)).join(last, keys, "full_outer")

    def merged(c: str) -> Column:
        if c in preserved:
            return F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"new_{c}"))
        return F.when(F.col("_new").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c))

    return joined.select(*keys, *[merged(c).alias(c) for c in columns])


def replace_source(problems: DataFrame, new: DataFrame) -> DataFrame:
    """Problems after re-importing the sources of `new`, variants of replaced problems included."""
    key = ["user_id", "source_id"]
    sources = new.select(*key).distinct()
    replaced = problems.join(sources, key, "left_semi").select("user_id", F.col("id").alias("parent_id"))
    kept = problems.join(sources, key, "left_anti").join(replaced, ["user_id", "parent_id"], "left_anti")
    return kept.unionByName(new)


def ttl_filter(cache: DataFrame, as_of: Column, ttl_seconds: Column) -> DataFrame:
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    return cache.where(age <= ttl_seconds)


# --- deletion ------------------------------------------------------------------------------------


def owned_rows(tables: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Rows each deletion request covers: (user_id, course_id, scope, table, row_id).

    `requests` holds user_id, course_id and scope. Every table has user_id and row_id, and the column
    that ties it to a course: course_id, source_id, chapter_ref or the id of its parent. The protected
    tenant's requests cover nothing.
    """
    allowed = requests.where(F.col("user_id") != PROTECTED_TENANT).select("user_id", "course_id", "scope").distinct()
    course = ["user_id", "course_id"]
    key = [*course, "scope"]
    parts: list[DataFrame] = []

    def of(*scopes: str) -> DataFrame:
        return allowed.where(F.col("scope").isin(*scopes))

    def take(name: str, rows: DataFrame) -> DataFrame:
        chosen = rows.select(*key, F.lit(name).alias("table"), F.col("row_id").cast("string").alias("row_id")).distinct()
        parts.append(chosen)
        return chosen

    def by_course(name: str, *scopes: str, where: Column | None = None) -> DataFrame:
        table = tables[name] if where is None else tables[name].where(where)
        return take(name, table.join(of(*scopes), course))

    def children(name: str, column: str, parents: DataFrame) -> DataFrame:
        ids = parents.select(*key, F.col("row_id").alias(column))
        table = tables[name].drop("course_id").withColumn(column, F.col(column).cast("string"))
        return take(name, table.join(ids, ["user_id", column]))

    kind, file = F.col("type"), F.lower("file")
    chosen = {
        "materials": kind.isin(MATERIAL_TYPES),
        "syllabus": (kind == "syllabus") | matches(file, SYLLABUS_FILE),
        "assessment_uploads": kind == "assessment",
        "entire_course": F.lit(True),
    }
    in_scope = F.lit(False)
    for scope, condition in chosen.items():
        in_scope = in_scope | ((F.col("scope") == scope) & condition)
    sources = take("sources", tables["sources"].join(allowed, course).where(in_scope))
    picked = sources.select(*key, F.col("row_id").alias("source_id"))
    everything = of("entire_course")
    for name in ("chunks", "chapters"):
        by_source = tables[name].join(picked.where("scope IN ('materials', 'syllabus')"), [*course, "source_id"])
        take(name, by_source.select(*key, "row_id").unionByName(tables[name].join(everything, course).select(*key, "row_id")))

    # an entire course also owns the parents of sources known only from its chunks, chapters or problems
    known = [tables[name].select(*course, "source_id") for name in ("chunks", "chapters", "problems")]
    loose = known[0].unionByName(known[1]).unionByName(known[2]).distinct().join(everything, course).select(*key, "source_id")
    take("parents", tables["parents"].drop("course_id").join(picked.unionByName(loose).distinct(), ["user_id", "source_id"]))

    schedule = by_course("schedule", "syllabus", "entire_course")
    assessments = by_course("assessments", "syllabus", "entire_course")
    from_syllabus = (F.col("scope") == "entire_course") | (F.col("notes") == SYLLABUS_NOTE)
    events = take("calendar_events", tables["calendar_events"].join(of("syllabus", "entire_course"), course).where(from_syllabus))
    by_course("grade_records", "syllabus", "entire_course")
    # check-offs name their item with a prefix and, for repeated events, a date
    items = (
        schedule.select(*key, F.concat(F.lit("sched:"), "row_id").alias("item"))
        .unionByName(events.select(*key, F.concat(F.lit("event:"), "row_id").alias("item")))
        .unionByName(assessments.where("scope = 'entire_course'").select(*key, F.concat(F.lit("assess:"), "row_id").alias("item")))
    )
    bare = F.regexp_extract("row_id", "^([a-z]+:[^:]+)", 1)
    take("task_status", tables["task_status"].withColumn("item", bare).join(items, ["user_id", "item"]))
    children("study_plans", "assessment_id", assessments)

    problems = by_course("problems", "assessment_uploads", "entire_course")
    solved = children("attempts", "problem_id", problems)
    uploads = of("assessment_uploads", "entire_course")
    attempts = tables["attempts"].withColumn("course_id", F.split_part("chapter_ref", F.lit(":"), F.lit(1)))
    parts.remove(solved)
    named = attempts.join(uploads, course).select(*key, F.lit("attempts").alias("table"), F.col("row_id").cast("string").alias("row_id"))
    parts.append(solved.unionByName(named).distinct())

    for name in ("engagement", "manual_progress"):
        rows = tables[name].withColumn("course_id", F.split_part("chapter_ref", F.lit(":"), F.lit(1)))
        take(name, rows.join(everything, course))
    conversations = by_course("conversations", "entire_course")
    messages = children("messages", "conversation_id", conversations)
    children("artifacts", "message_id", messages)
    for name in ("ingest_jobs", "agent_runs"):
        by_course(name, "entire_course")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def delete_preview(tables: Mapping[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Rows per request and table that a deletion would remove."""
    owned = owned_rows(tables, requests)
    return owned.groupBy("user_id", "course_id", "scope", "table").agg(F.count("*").alias("n_rows"))


def without_rows(table: DataFrame, name: str, doomed: DataFrame) -> DataFrame:
    """`table` without the doomed rows (user_id, table, row_id) of its name."""
    gone = doomed.where(F.col("table") == name).select("user_id", F.col("row_id").alias("_gone"))
    marked = table.withColumn("_gone", F.col("row_id").cast("string"))
    return marked.join(gone, ["user_id", "_gone"], "left_anti").drop("_gone")


def delete_cascade(tables: Mapping[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows the requests cover; rows of other tenants are never touched.

    The covered rows are written once before any table is filtered, so children are resolved against
    parents that still exist.
    """
    doomed = cut_lineage(owned_rows(tables, requests).select("user_id", "table", "row_id").distinct())
    return {name: without_rows(df, name, doomed) for name, df in tables.items()}


# --- audits -----------------------------------------------------------------------------------------


def orphan_audit(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist in their tenant, with whether another tenant has it."""
    own = parents.select("user_id", F.col(parent_key).alias(child_key))
    orphans = children.join(own, ["user_id", child_key], "left_anti")
    elsewhere = parents.groupBy(F.col(parent_key).alias(child_key)).agg(F.count_distinct("user_id").alias("n_tenants"))
    return orphans.join(elsewhere, child_key, "left").withColumn("foreign", F.col("n_tenants").isNotNull()).drop("n_tenants")


def tenant_audit(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per link (child, column, parent): rows whose parent belongs to another tenant only.

    Fails when a table has no tenant column.
    """
    for name, df in tables.items():
        if "user_id" not in df.columns:
            raise ValueError(f"{name} has no user_id")
    out = None
    for child, column, parent in links:
        rows = orphan_audit(tables[child].select("user_id", column), tables[parent], column, "row_id")
        counted = rows.agg(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"),
            F.count("*").alias("orphans"), F.count_if("foreign").alias("foreign_rows"),
        )
        out = counted if out is None else out.unionByName(counted)
    return out
