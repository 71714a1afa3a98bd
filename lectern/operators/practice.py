"""Practice problems: queues, tests, answer grading, key checks, imports and help limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.functions.common import first_row, matches, once, ratio, sql_round, top_rows
from lectern.operators.scans import running_sum
from lectern.operators.syllabus import CHAPTERS_PER_PACK

# --- queues and tests -----------------------------------------------------------------------


def practice_queue(problems: DataFrame, attempts: DataFrame) -> DataFrame:
    """Problems with their attempt history, missed ones first."""
    key = ["user_id", "problem_id"]
    history = attempts.groupBy(*key).agg(F.count("*").alias("n_attempts"), F.count_if(~F.col("correct")).alias("misses"))
    out = problems.join(history, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_attempts", "misses")})
    out = out.withColumns(
        {
            "clean": (F.col("misses") == 0).cast("int"),
            "fewer": -F.col("misses"),
            "variant": (F.col("origin") != "uploaded").cast("int"),
            "max_help": help_cap(F.col("origin")),
        }
    )
    # places are counted per block of equal leading order columns, so a user may own any share of the rows
    block = F.struct("clean", "fewer", "variant", "number")
    order = ["clean", "fewer", "variant", "number", "problem_id"]
    placed = running_sum(out, ["user_id"], order, block, F.lit(1), "place")
    return placed.drop("clean", "fewer", "variant")


def assemble_test(problems: DataFrame, exam_refs: DataFrame, n: int = 8) -> DataFrame:
    """The first n verified generated problems of each user, exam chapters first."""
    ready = problems.where((F.col("origin") == "generated") & F.col("verified"))
    covered = exam_refs.select("user_id", "chapter_ref").distinct().withColumn("covered", F.lit(True))
    flagged = ready.join(covered, ["user_id", "chapter_ref"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return top_rows(flagged, ["user_id"], [F.desc("covered"), F.asc("problem_id")], n, "place")


def attempt_credit(attempts: DataFrame, problems: DataFrame) -> DataFrame:
    """Problem-set credit per chapter, and the mean clamped help level."""
    known = problems.where("chapter_ref <> ''").select("user_id", "problem_id", "chapter_ref")
    level = F.greatest(F.lit(0), F.least(F.lit(3), F.col("help_level")))
    per_problem = attempts.groupBy("user_id", "problem_id").agg(F.count("*").alias("n"), F.sum(level).alias("help"))
    return per_problem.join(known, ["user_id", "problem_id"]).groupBy("user_id", "chapter_ref").agg(
        F.sum("n").alias("ps_hits"), F.sum("help").alias("help_total")
    )


# --- grading -----------------------------------------------------------------------------------


def _close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def answer_pairs(text: Column) -> Column:
    """'x = 1, y = 2.5' as an array of (name, value)."""
    source = F.coalesce(text, F.lit(""))
    names = F.regexp_extract_all(source, F.lit(V.ANSWER_PAIR), F.lit(1))
    values = F.regexp_extract_all(source, F.lit(V.ANSWER_PAIR), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.cast("double").alias("value")))


def grade_answers(answers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `correct`: every expected name is given with a close value (the last one counts)."""

    def last(pairs: str, name: Column) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(-1))["value"]

    parsed = answers.withColumns({"want": answer_pairs(F.col("expected")), "have": answer_pairs(F.col("entered"))})
    names = F.array_distinct(F.transform("want", lambda p: p["name"]))
    every = F.forall(
        names,
        lambda n: F.coalesce(_close(last("have", n), last("want", n), V.GRADE_REL_TOL, V.GRADE_ABS_TOL), F.lit(False)),
    )
    return parsed.withColumn("correct", (F.size("want") > 0) & every).drop("want", "have")


def test_score(graded: DataFrame, *keys: str) -> DataFrame:
    return graded.groupBy(*keys).agg(
        F.count_if("correct").alias("score"), F.count("*").alias("total"),
        F.bround(100 * F.count_if("correct") / F.count("*")).cast("long").alias("percent"),
    )


# --- answer keys ---------------------------------------------------------------------------------


def _template_truth() -> dict[str, dict[str, Column]]:
    """Closed-form answers of each template as columns over `params`."""
    p = {k: F.try_element_at("params", F.lit(k)) for k in ("a", "b", "m", "p1", "p2", "A", "B", "P0", "c", "w", "r", "Q")}
    div = F.try_divide
    demand = p["A"] - p["B"] * p["P0"]
    monopoly = div(p["A"] - p["c"], 2 * p["B"])
    price = p["A"] - p["B"] * monopoly
    mix = div(p["a"] * p["r"], p["b"] * p["w"])
    capital = F.pow(div(p["Q"], F.pow(mix, p["a"])), div(F.lit(1.0), p["a"] + p["b"]))
    return {
        "cobb_douglas_utility_max": {
            "x1": div(p["a"] * p["m"], (p["a"] + p["b"]) * p["p1"]),
            "x2": div(p["b"] * p["m"], (p["a"] + p["b"]) * p["p2"]),
        },
        "budget_line": {
            "x1_intercept": div(p["m"], p["p1"]), "x2_intercept": div(p["m"], p["p2"]), "slope": -div(p["p1"], p["p2"]),
        },
        "price_elasticity": {"quantity": demand, "elasticity": div(-p["B"] * p["P0"], demand)},
        "cost_minimization": {"L": capital * mix, "K": capital, "cost": p["w"] * capital * mix + p["r"] * capital},
        "profit_max_monopoly": {"quantity": monopoly, "price": price, "profit": (price - p["c"]) * monopoly},
    }


def verify_keys(problems: DataFrame) -> DataFrame:
    """Adds `route`: verified, discarded or unverified.

    `problems`: template, type, params and claimed (map<string,double>). Every answer of the template
    must be claimed and close to the recomputed one; work of a numeric type without a template is
    discarded, other work is kept unverified.
    """
    ok = F.lit(False)
    known = F.lit(False)
    for template, truth in _template_truth().items():
        checks = F.lit(True)
        for label, value in truth.items():
            claim = F.try_element_at("claimed", F.lit(label))
            near = _close(claim, value, V.VERIFY_REL_TOL, 1e-6) | (
                F.abs(claim - value) <= V.VERIFY_REL_TOL * F.greatest(F.lit(1.0), F.abs(claim), F.abs(value))
            )
            finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
            checks = checks & F.coalesce(finite & near, F.lit(False))
        is_template = F.col("template") == template
        known = known | is_template
        ok = ok | (is_template & checks)
    numeric = F.col("type").isin("numeric", "symbolic", "symbolic_derivation")
    route = (
        F.when(known & ok, "verified").when(known, "discarded").when(numeric, "discarded").otherwise("unverified")
    )
    return problems.withColumn("route", route)


# --- imports -----------------------------------------------------------------------------------------


def problem_normalise(raw: DataFrame) -> DataFrame:
    """Parsed problems with known types, defaults and the review flag; empty prompts disappear."""

    def text(name: str, default: str = "") -> Column:
        return P.strip(F.coalesce(name, F.lit(default)))

    kind = F.lower(text("type", "short_answer"))
    aliases = F.create_map(*[F.lit(x) for pair in V.PROBLEM_TYPE_ALIASES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(aliases, kind), F.replace(kind, F.lit("-"), F.lit("_")))
    confidence = F.when(F.col("confidence").isNull(), 0.5).otherwise(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)))
    others = [c for c in raw.columns if c not in ("number", "prompt", "type", "topic", "difficulty", "given_solution", "confidence")]
    return raw.where(text("prompt") != "").select(
        *others, F.substring(text("number"), 1, 12).alias("number"), text("prompt").alias("prompt"),
        F.when(kind.isin(V.PROBLEM_TYPES), kind).otherwise("short_answer").alias("type"),
        F.substring(text("topic"), 1, 80).alias("topic"), F.lower(text("difficulty", "standard")).alias("difficulty"),
        text("given_solution").alias("given_solution"), confidence.alias("confidence"),
        (confidence < V.PROBLEM_CONFIDENCE_FLOOR).alias("needs_review"),
    )


def import_report(problems: DataFrame, *keys: str) -> DataFrame:
    """Parsed, flagged, kept, discarded and unverified problems per import.

    `problems`: origin (uploaded | generated), needs_review, route (of generated ones).
    """
    generated = F.col("origin") == "generated"

    def routed(name: str) -> Column:
        return F.count_if(generated & (F.col("route") == name))

    return problems.groupBy(*keys).agg(
        F.count_if(~generated).alias("parsed"), F.count_if(~generated & F.col("needs_review")).alias("to_review"),
        routed("verified").alias("kept"), routed("discarded").alias("discarded"), routed("unverified").alias("unverified"),
        F.round(ratio(routed("discarded"), F.count_if(generated)), 3).alias("discard_rate"),
    )


def practice_link(problems: DataFrame, chapters: DataFrame, floor: float = V.PRACTICE_LINK_FLOOR) -> DataFrame:
    """Chapter of each problem, null when no title is specific and similar enough.

    A problem meets the chapters of its course that share a specific word with it. They come as packed arrays, and it leaves
    each pack with its best one, so neither words nor problem-chapter pairs become rows. `problems`: user_id, course_id,
    problem_id, topic, prompt. `chapters`: user_id, course_id, source_id, chapter_num, title.
    """
    key, course = ["user_id", "problem_id"], ["user_id", "course_id"]
    generic = X.tokens(F.lit(V.GENERIC_CHAPTER_TERMS))

    def facts(text: Column) -> dict[str, Column]:
        return {"specific": F.array_except(X.tokens(text), generic), "words": X.title_tokens(text)}

    query = F.concat("topic", F.lit(" "), F.substring("prompt", 1, 120))
    asked = once(problems.select(*key, "course_id", query.alias("query")), **facts(F.col("query"))).drop("query")
    titled = once(chapters.select(*course, "source_id", "chapter_num", "title"), **facts(F.col("title")))
    place = F.row_number().over(Window.partitionBy(*course).orderBy("source_id", "chapter_num")) - 1
    entry = F.struct("source_id", "chapter_num", "specific", "words")
    packs = titled.withColumn("pack_no", F.floor(place / CHAPTERS_PER_PACK)).groupBy(*course, "pack_no").agg(F.collect_list(entry).alias("pack"))

    def scored(c: Column) -> Column:
        score = sql_round(X.set_similarity(F.col("words"), c["words"]), 6)
        return F.struct((-score).alias("neg"), c["source_id"].alias("source_id"), c["chapter_num"].alias("chapter_num"))

    near = F.filter("pack", lambda c: F.arrays_overlap(F.col("specific"), c["specific"]))
    best = once(asked.join(packs, course), best=F.array_min(F.transform(near, scored))).where(-F.col("best.neg") >= floor)
    best = best.select(*key, "course_id", (-F.col("best.neg")).alias("score"), "best.source_id", "best.chapter_num")
    best = first_row(best, key, [F.desc("score"), F.asc("source_id"), F.asc("chapter_num")])
    ref = F.concat_ws(":", "course_id", "source_id", F.col("chapter_num").cast("string"))
    return problems.select(*key).join(best.select(*key, ref.alias("chapter_ref"), "score"), key, "left")


# --- help --------------------------------------------------------------------------------------------


def help_cap(origin: Column) -> Column:
    return F.when(origin == "uploaded", 2).otherwise(3)


def help_gate(requests: DataFrame) -> DataFrame:
    """Adds the granted level and the text without worked arithmetic or conclusions.

    `requests`: origin, level, text.
    """
    granted = F.least(help_cap(F.col("origin")), F.greatest(F.lit(1), F.least(F.lit(3), F.col("level"))))
    parts = F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), P.strip)
    kept = F.filter(parts, lambda s: (s != "") & ~s.rlike(V.HELP_ARITHMETIC) & ~matches(s, V.HELP_CONCLUSION))
    blocked = F.col("level") > help_cap(F.col("origin"))
    return requests.withColumns({"granted": granted, "blocked": blocked, "method": F.array_join(kept, " ")})
