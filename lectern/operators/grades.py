"""Grade books of all students and courses at once.

A book is one row: `components` (name, weight, aggregation, drop_lowest, drop_highest, items (item, share,
score)), `extra` (item, points, score), `rules` (source_item, target, if_higher) and `scale` (letter,
minimum). Its size is that of one syllabus, so the arithmetic stays inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import fixed_values as V
from lectern.functions.common import first_row, let
from lectern.session import ship_package

DEFAULT_SCALE = [("A", 93.0), ("B", 83.0), ("C", 73.0), ("D", 60.0)]
_EXTRA = "array<struct<item:bigint,points:double,score:double>>"
_RULES = "array<struct<source_item:bigint,target:string,if_higher:boolean>>"


def scale_column(scale: Sequence[tuple[str, float]] = tuple(DEFAULT_SCALE)) -> Column:
    ordered = sorted(scale, key=lambda pair: -pair[1])
    return F.array(*[F.struct(F.lit(letter).alias("letter"), F.lit(minimum).alias("minimum")) for letter, minimum in ordered])


def build_books(
    components: DataFrame, items: DataFrame, extra: DataFrame, rules: DataFrame, keys: Sequence[str], scale: Column | None = None
) -> DataFrame:
    """One book per key from the rows of its rules and scores."""
    keys = list(keys)
    listed = items.groupBy(*keys, "component").agg(F.array_sort(F.collect_list(F.struct("item", "share", "score"))).alias("items"))
    entry = F.struct(
        F.col("component").alias("name"), F.col("weight").cast("double").alias("weight"), "aggregation",
        F.col("drop_lowest").cast("int").alias("drop_lowest"), F.col("drop_highest").cast("int").alias("drop_highest"), "items",
    )
    books = components.join(listed, [*keys, "component"]).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("components"))
    bonus = extra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("item").cast("long").alias("item"), "points", "score"))).alias("extra"))
    swaps = rules.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_item").cast("long").alias("source_item"), "target", "if_higher"))).alias("rules")
    )
    out = books.join(bonus, keys, "left").join(swaps, keys, "left")
    return out.withColumns(
        {
            "extra": F.coalesce("extra", F.array().cast(_EXTRA)),
            "rules": F.coalesce("rules", F.array().cast(_RULES)),
            "scale": scale if scale is not None else scale_column(),
        }
    )


# --- arithmetic inside a book ------------------------------------------------------------------


def _with_items(c: Column, items: Column) -> Column:
    return F.struct(
        c["name"].alias("name"), c["weight"].alias("weight"), c["aggregation"].alias("aggregation"),
        c["drop_lowest"].alias("drop_lowest"), c["drop_highest"].alias("drop_highest"), items.alias("items"),
    )


def _item(i: Column, score: Column) -> Column:
    return F.struct(i["item"].alias("item"), i["share"].alias("share"), score.alias("score"))


def _known(items: Column) -> Column:
    return F.filter(items, lambda i: i["score"].isNotNull())


def fill_scores(components: Column, value: Column) -> Column:
    """Components with every missing score set to `value`."""
    return F.transform(
        components, lambda c: _with_items(c, F.transform(c["items"], lambda i: _item(i, F.coalesce(i["score"], value))))
    )


def replace_lowest(components: Column, rules: Column) -> Column:
    """Apply the replacement rules in order.

    A known source score takes the place of the lowest score of a complete target component, if it is
    higher or the rule does not ask for that.
    """

    def apply(parts: Column, rule: Column) -> Column:
        everything = F.flatten(F.transform(parts, lambda c: c["items"]))
        source = F.try_element_at(F.filter(everything, lambda i: i["item"] == rule["source_item"]), F.lit(1))["score"]

        def swap(c: Column) -> Column:
            scores = F.transform(c["items"], lambda i: i["score"])
            complete = ~F.exists(c["items"], lambda i: i["score"].isNull())

            def decide(low: Column) -> Column:
                place = F.array_position(scores, low)
                due = (c["name"] == rule["target"]) & complete & source.isNotNull() & (~rule["if_higher"] | (source > low))
                changed = F.transform(
                    c["items"], lambda i, n: _item(i, F.when((n + 1) == place, source).otherwise(i["score"]))
                )
                return F.when(F.coalesce(due, F.lit(False)), _with_items(c, changed)).otherwise(c)

            return let(F.array_min(scores), decide)

        return F.transform(parts, swap)

    return F.aggregate(rules, components, apply)


def component_results(components: Column) -> Column:
    """Per component: name, weight, complete, average, completed weight and weighted points."""

    def result(c: Column) -> Column:
        def counted(known: Column) -> Column:
            complete = F.size(known) == F.size(c["items"])
            dropped = F.when(complete, c["drop_lowest"] + c["drop_highest"]).otherwise(0)
            ordered = F.array_sort(
                F.transform(known, lambda i: F.struct(i["score"].alias("score"), i["item"].alias("item"), i["share"].alias("share")))
            )
            kept = F.when(
                complete, F.slice(ordered, c["drop_lowest"] + 1, F.greatest(F.size(ordered) - dropped, F.lit(0)))
            ).otherwise(ordered)

            def sums(k: Column) -> Column:
                weighted = c["aggregation"] == "weighted"
                share = F.aggregate(k, F.lit(0.0), lambda s, i: s + F.coalesce(i["share"].cast("double"), F.lit(0.0)))
                mass = F.aggregate(
                    k, F.lit(0.0), lambda s, i: s + i["score"] * F.when(weighted, i["share"].cast("double")).otherwise(1.0)
                )
                size = F.when(weighted, share).otherwise(F.size(k).cast("double"))
                average = F.when(size != 0, mass / size)
                fraction = F.when(weighted, F.least(F.lit(1.0), share)).otherwise(
                    F.coalesce(F.try_divide(F.size(k).cast("double"), (F.size(c["items"]) - dropped).cast("double")), F.lit(0.0))
                )
                nothing = F.size(known) == 0
                done = F.when(nothing, 0.0).otherwise(c["weight"] * fraction)
                return F.struct(
                    c["name"].alias("name"), c["weight"].alias("weight"), (complete & ~nothing).alias("complete"),
                    F.when(~nothing, average).alias("average"), done.alias("completed_weight"),
                    (done * F.coalesce(average, F.lit(0.0)) / 100).alias("points"),
                )

            return let(kept, sums)

        return let(_known(c["items"]), counted)

    return F.transform(components, result)


def _total(results: Column, field: str) -> Column:
    return F.aggregate(results, F.lit(0.0), lambda s, r: s + r[field])


def _extra_points(extra: Column, missing: Column) -> Column:
    return F.aggregate(
        extra,
        F.lit(0.0),
        lambda s, e: s + F.coalesce(e["points"], F.lit(0.0)) * F.coalesce(e["score"], missing, F.lit(0.0)) / 100,
    )


def course_result(components: Column, extra: Column, rules: Column, extra_missing: Column | None = None) -> Column:
    """Earned, completed, current and projected percent of one book."""
    missing = extra_missing if extra_missing is not None else F.lit(None).cast("double")

    def finish(results: Column) -> Column:
        def percent(s: Column) -> Column:
            earned = s["points"] + s["bonus"] / 100
            whole = (F.abs(s["weight"] - 1.0) <= V.WEIGHT_TOLERANCE) & s["complete"]
            return F.struct(
                (earned * 100).alias("earned"), s["bonus"].alias("extra_points"), s["done"].alias("completed_weight"),
                F.greatest(F.lit(0.0), 1 - s["weight"]).alias("unallocated_weight"),
                F.when(s["done"] != 0, earned / s["done"] * 100).alias("current_percent"),
                F.when(whole, earned * 100 + F.greatest(F.lit(0.0), 1 - s["done"]) * 100).alias("projected_percent"),
            )

        sums = F.struct(
            _total(results, "points").alias("points"), _extra_points(extra, missing).alias("bonus"),
            _total(results, "completed_weight").alias("done"), _total(results, "weight").alias("weight"),
            F.forall(results, lambda r: r["complete"]).alias("complete"),
        )
        return let(sums, percent)

    return let(component_results(replace_lowest(components, rules)), finish)


def letter_of(scale: Column, percent: Column) -> Column:
    """Letter of the highest threshold at or below the percent.

    The percent counts to nine digits, so 73 reached through a sum of thirds is still 73.
    """
    return F.try_element_at(F.filter(scale, lambda s: s["minimum"] <= F.round(percent, 9)), F.lit(1))["letter"]


# --- reports --------------------------------------------------------------------------------------


def category_results(books: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component with drops and replacements applied."""
    results = component_results(replace_lowest(F.col("components"), F.col("rules")))
    return books.select(*keys, F.explode(results).alias("r")).select(*keys, "r.*")


def gradebook(books: DataFrame, keys: Sequence[str]) -> DataFrame:
    result = course_result(F.col("components"), F.col("extra"), F.col("rules"))
    out = books.select(*keys, "scale", F.explode(F.array(result)).alias("r")).select(*keys, "scale", "r.*")
    return out.withColumns(
        {
            "current_letter": letter_of(F.col("scale"), F.col("current_percent")),
            "projected_letter": letter_of(F.col("scale"), F.col("projected_percent")),
        }
    ).drop("scale")


def letter_grade(percents: DataFrame, scale: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Letters by a table of scales: highest minimum not above the percent, null below all of them."""
    hits = percents.join(scale, list(keys)).where(F.col("minimum") <= F.col("percent"))
    best = hits.groupBy(*keys).agg(F.max_by("letter", "minimum").alias("letter"))
    return percents.join(best, list(keys), "left")


# --- targets ----------------------------------------------------------------------------------------


def _breaks(components: Column, rules: Column) -> Column:
    """0, 100 and every known score between them at which the open scores may change places with a known one.

    Where no rule replaces scores, only components that drop some and are still open matter.
    """

    def known(c: Column) -> Column:
        is_open = F.exists(c["items"], lambda i: i["score"].isNull())
        matters = (F.size(rules) > 0) | ((c["drop_lowest"] + c["drop_highest"] > 0) & is_open)
        scores = F.transform(F.filter(c["items"], lambda i: (i["score"] > 0) & (i["score"] < 100)), lambda i: i["score"].cast("double"))
        return F.when(matters, scores).otherwise(F.array().cast("array<double>"))

    inner = F.flatten(F.transform(components, known))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(100.0)))))


_POINT = 9  # digits to which a projected percent counts


def _curve(breaks: Column, projected) -> Column:
    """The projection as array<struct<lo, at, mid, value, slope>>: its value at each break, and the line up to the next.

    Between two breaks the order of all scores is fixed, so the same ones count and the projection is a straight line;
    two points inside give it. At a break it may jump, where weighted scores change places.
    """

    def segment(lo: Column, i: Column) -> Column:
        width = F.coalesce(F.try_element_at(breaks, i + 2) - lo, F.lit(0.0))
        ends = F.struct((lo + width * 0.25).alias("a"), (lo + width * 0.75).alias("b"))

        def line(e: Column) -> Column:
            values = F.struct(projected(lo).alias("at"), projected(e["a"]).alias("ya"), projected(e["b"]).alias("yb"))
            return let(
                values,
                lambda v: F.struct(
                    lo.alias("lo"), F.round(v["at"], _POINT).alias("at"), e["a"].alias("mid"), v["ya"].alias("value"),
                    F.when(width > 0, (v["yb"] - v["ya"]) / (width * 0.5)).otherwise(0.0).alias("slope"),
                ),
            )

        return let(ends, line)

    return F.transform(breaks, lambda lo, i: segment(lo, i))


def _on_curve(curve: Column, x: Column) -> Column:
    here = F.try_element_at(F.filter(curve, lambda c: c["lo"] <= x), F.lit(-1))
    return let(here, lambda c: F.when(c["lo"] == x, c["at"]).otherwise(F.round(c["value"] + c["slope"] * (x - c["mid"]), _POINT)))


def _bisect(reached, steps: int) -> Column:
    """Smallest value in [0, 100] for which `reached(value)` holds, by halving."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return let(
            F.struct(mid.alias("mid"), F.coalesce(reached(mid), F.lit(False)).alias("ok")),
            lambda m: F.struct(F.when(m["ok"], s["lo"]).otherwise(m["mid"]).alias("lo"), F.when(m["ok"], m["mid"]).otherwise(s["hi"]).alias("hi")),
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["hi"])


def target_facts(books: DataFrame) -> DataFrame:
    """What every target of a book is decided by: open parts, current percent, the highest projection and its curve.

    The curve runs over a uniform score of the open items, or of the open extra credit where no item is open. It is worked
    out once for each book, whatever the number of targets.
    """
    c, e, r = F.col("components"), F.col("extra"), F.col("rules")
    open_items = F.aggregate(c, F.lit(0), lambda s, x: s + F.size(F.filter(x["items"], lambda i: i["score"].isNull())))
    weights = F.aggregate(c, F.lit(0.0), lambda s, x: s + x["weight"])
    facts = books.withColumns(
        {
            "open_items": open_items,
            "open_extra": F.size(F.filter(e, lambda x: x["score"].isNull())),
            "broken": F.exists(e, lambda x: x["points"].isNull()) | (F.abs(weights - 1.0) > V.WEIGHT_TOLERANCE),
            "breaks": _breaks(c, r),
        }
    )

    def projected(x: Column) -> Column:
        return course_result(fill_scores(c, x), e, r, F.when(F.col("open_items") == 0, x))["projected_percent"]

    return facts.withColumns(
        {
            "current": course_result(c, e, r)["current_percent"],
            "maximum": course_result(fill_scores(c, F.lit(100.0)), e, r, F.lit(100.0))["projected_percent"],
            "curve": F.when(~F.col("broken"), _curve(F.col("breaks"), projected)),
        }
    ).drop("breaks")


def target_verdicts(facts: DataFrame, target: str = "target", steps: int = 50) -> DataFrame:
    """Status, required score and bounds of each target from `target_facts`."""
    goal, curve = F.col(target), F.col("curve")
    nothing_open = (F.col("open_items") == 0) & (F.col("open_extra") == 0)
    minimum = F.try_element_at(curve, F.lit(1))["at"]
    status = (
        F.when(F.col("broken"), "incomplete_structure")
        .when(nothing_open & F.coalesce(F.col("current") >= goal, F.lit(False)), "achieved")
        .when(nothing_open, "impossible")
        .when(F.col("maximum") + 1e-8 < goal, "impossible")
        .when(minimum + 1e-8 >= goal, "guaranteed")
        .when(F.col("open_items") == 0, "extra_credit_only")
        .otherwise("achievable")
    )
    required = F.when(F.col("status") == "guaranteed", 0.0).when(
        F.col("status").isin("achievable", "extra_credit_only"), _bisect(lambda x: _on_curve(curve, x) >= goal, steps)
    )
    bound = F.when(~F.col("broken"), F.when(nothing_open, F.col("current")).otherwise(F.col("maximum")))
    out = facts.withColumn("status", status).withColumn("required", required).withColumn("maximum_possible", bound)
    return out.drop("broken", "maximum", "curve")


def solve_target(books: DataFrame, target: str = "target", steps: int = 50) -> DataFrame:
    """Uniform score on the open items that reaches `target`, with status and bounds.

    The projection is a straight line between known scores, so halving runs on its curve and not on the book. Where
    weighted scores are dropped it can fall when the score rises; then the crossing that halving meets is returned.
    """
    return target_verdicts(target_facts(books), target, steps)


def grade_ladder(books: DataFrame) -> DataFrame:
    """Requirement for every letter of the scale, all from one curve."""
    rungs = target_facts(books).withColumn("s", F.explode("scale")).withColumns({"letter": F.col("s.letter"), "target": F.col("s.minimum")})
    return target_verdicts(rungs.drop("s"))


#: Books whose scenarios are worked out at once.
BOOKS_AT_ONCE = 4096
_CURVE = "array<struct<lo: double, at: double, mid: double, value: double, slope: double>>"


def _rounded(values: np.ndarray) -> np.ndarray:
    """To the digits of a point, as the SQL does it: scaled, halves away from zero."""
    scaled = values * 10.0**_POINT
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**_POINT


def _numbers(values: pa.Array) -> np.ndarray:
    """Doubles, null as NaN."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Lists:
    """A column of arrays of structs: its fields end to end, and where each row's entries are."""

    def __init__(self, column: pa.ListArray):
        self.fields, self.sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(column)), self.sizes)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the given rows, and which of the given rows each belongs to."""
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return at, np.repeat(np.arange(len(rows)), sizes)

    def __getitem__(self, name: str) -> pa.Array:
        return self.fields.field(name)


def _item_projections(books: pa.RecordBatch, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Projected percent of book `row` (NaN: none) where its asked item scores x and other open ones what is assumed.

    The same steps in the same order as `course_result`, over all given scenarios together. No score is missing here.
    """
    parts, extra, rules = (_Lists(books.column(c)) for c in ("components", "extra", "rules"))
    items = _Lists(parts["items"])
    asked, assumption = _numbers(books.column("item_id")), books.column("assumption").to_pylist()
    assumed = np.array([{"zero": 0.0, "hundred": 100.0}.get(a, np.nan) for a in assumption])[row]
    others = np.where(np.isnan(assumed), x, assumed)

    def filled(lists: _Lists, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        score = _numbers(lists["score"])[at]
        return np.where(np.isnan(score), np.where(_numbers(lists["item"])[at] == asked[row][of], x[of], others[of]), score)

    # components of each scenario, and the items of those
    part, scenario = parts.of(row)
    item, owner = items.of(part)
    score = filled(items, item, scenario[owner])
    sizes = items.sizes[part]
    starts = np.cumsum(sizes) - sizes
    number, names = _numbers(items["item"])[item], np.array(parts["name"].to_pylist(), object)[part]
    for nth in range(rules.sizes.max(initial=0)):
        has = rules.sizes[row] > nth
        rule = np.where(has, rules.starts[row] + nth, 0)
        source_item = np.where(has, _numbers(rules["source_item"])[rule], np.nan)
        target = np.where(has, np.array(rules["target"].to_pylist(), object)[rule], None)
        always = pc.fill_null(pc.invert(rules["if_higher"]), False).to_numpy(zero_copy_only=False)[rule]
        found = np.flatnonzero(number == source_item[scenario[owner]])
        source = np.full(len(row), np.nan)
        source[scenario[owner[found[::-1]]]] = score[found[::-1]]  # the first one stays
        due = np.flatnonzero((names == target[scenario]) & (sizes > 0) & ~np.isnan(source[scenario]))
        if len(due):
            at = np.repeat(starts[due] - (np.cumsum(sizes[due]) - sizes[due]), sizes[due]) + np.arange(sizes[due].sum())
            low = np.minimum.reduceat(score[at], np.cumsum(sizes[due]) - sizes[due])
            lowest = at[score[at] == np.repeat(low, sizes[due])]
            first = lowest[np.unique(owner[lowest], return_index=True)[1]]
            swap = always[scenario[due]] | (source[scenario[due]] > low)
            score[first[swap]] = source[scenario[due]][swap]
    share = _numbers(items["share"])[item]
    order = np.lexsort((np.where(np.isnan(share), -np.inf, share), number, score, owner))
    score, share = score[order], share[order]
    low, high = (_numbers(parts[c])[part] for c in ("drop_lowest", "drop_highest"))
    weighted = pc.equal(parts["aggregation"], "weighted").to_numpy(zero_copy_only=False).astype(bool)[part]
    place, left = np.arange(len(order)) - starts[owner], sizes - (low + high)
    kept = (place >= low[owner]) & (place < (low + np.maximum(left, 0))[owner])
    owner, score, share = owner[kept], score[kept], share[kept]

    def total(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of, values, minlength=n)  # adds in order of the rows

    shares, count = total(owner, np.nan_to_num(share), len(part)), np.bincount(owner, minlength=len(part))
    mass = total(owner, score * np.where(weighted[owner], share, 1.0), len(part))
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.where(weighted, shares, count)
        average = np.where(size != 0, mass / size, np.nan)
        fraction = np.where(weighted, np.minimum(1.0, shares), np.where(left != 0, count / left, 0.0))
    weight = _numbers(parts["weight"])[part]
    done = np.where(sizes == 0, 0.0, weight * fraction)
    n = len(row)
    points, finished, weights = (total(scenario, v, n) for v in (done * np.nan_to_num(average) / 100, done, weight))
    more, of = extra.of(row)
    bonus = total(of, np.nan_to_num(_numbers(extra["points"])[more]) * filled(extra, more, of) / 100, n)
    whole = (np.abs(weights - 1.0) <= V.WEIGHT_TOLERANCE) & (total(scenario, sizes == 0, n) == 0)
    return np.where(whole, (points + bonus / 100) * 100 + np.maximum(0.0, 1 - finished) * 100, np.nan)


def _item_curves(books: pa.RecordBatch, steps: int) -> tuple[pa.ListArray, np.ndarray]:
    """Each book's curve over its asked item's score, as `_curve` has it, and the score found by halving."""
    breaks = books.column("breaks")
    sizes = pc.fill_null(pc.list_value_length(breaks), 0).to_numpy().astype(np.int64)
    lo, row = _numbers(breaks.flatten()), np.repeat(np.arange(len(books)), sizes)
    inner = np.flatnonzero(row[1:] == row[:-1])
    width = np.zeros(len(lo))
    width[inner] = lo[inner + 1] - lo[inner]
    ends = [lo[inner] + width[inner] * p for p in (0.25, 0.75)]
    found = _item_projections(books, np.concatenate([row, row[inner], row[inner]]), np.concatenate([lo, *ends]))
    value, slope, mid = found[: len(lo)].copy(), np.zeros(len(lo)), lo.copy()
    at, (first, second) = _rounded(value), np.split(found[len(lo) :], 2)
    mid[inner], value[inner], slope[inner] = ends[0], first, (second - first) / (width[inner] * 0.5)
    # halving, over all books together: a book's breaks are a row of a table
    table = np.full((len(books), sizes.max(initial=1)), np.inf)
    table[row, np.arange(len(lo)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lo
    some = np.flatnonzero(sizes)
    table, starts, goal = table[some], (np.cumsum(sizes) - sizes)[some], _numbers(books.column("target"))[some]
    low, high = np.zeros(len(some)), np.full(len(some), 100.0)
    for _ in range(steps if len(some) else 0):
        x = (low + high) / 2
        here = starts + (table <= x[:, None]).sum(axis=1) - 1
        y = np.where(lo[here] == x, at[here], _rounded(value[here] + slope[here] * (x - mid[here])))
        ok = y + 1e-10 >= goal
        low, high = np.where(ok, low, x), np.where(ok, x, high)
    exact = np.full(len(books), np.nan)
    exact[some] = high
    fields = [pa.array(v, mask=np.isnan(v)) for v in (lo, at, mid, value, slope)]
    structs = pa.StructArray.from_arrays(fields, ["lo", "at", "mid", "value", "slope"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), structs), exact


def _with_item_curves(books: DataFrame, steps: int) -> DataFrame:
    """Adds `curve` and `exact` to books with `breaks`; the scenarios of many books are worked out together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BOOKS_AT_ONCE):
                some = batch.slice(start, BOOKS_AT_ONCE)
                curve, exact = _item_curves(some, steps)
                yield pa.RecordBatch.from_arrays([*some.columns, curve, pa.array(exact)], [*some.schema.names, "curve", "exact"])

    ship_package(books.sparkSession)
    schema = T.StructType([*books.schema.fields, *T.StructType.fromDDL(f"curve {_CURVE}, exact double").fields])
    return books.mapInArrow(work, schema)


def solve_item_target(books: DataFrame, steps: int = 60) -> DataFrame:
    """Score one open item needs for `target`, the other open items assumed same, zero or hundred.

    `books` also carries item_id, target and assumption (same_score | zero | hundred).
    """
    c, e, r, goal = F.col("components"), F.col("extra"), F.col("rules"), F.col("target")
    everything = F.flatten(F.transform(c, lambda x: x["items"]))
    own = F.try_element_at(F.filter(everything, lambda i: i["item"] == F.col("item_id")), F.lit(1))
    bonus_own = F.try_element_at(F.filter(e, lambda x: x["item"] == F.col("item_id")), F.lit(1))

    weights = F.aggregate(c, F.lit(0.0), lambda s, x: s + x["weight"])
    broken = F.exists(e, lambda x: x["points"].isNull()) | (F.abs(weights - 1.0) > V.WEIGHT_TOLERANCE)
    graded = F.coalesce(own["score"], bonus_own["score"]).isNotNull()
    facts = _with_item_curves(books.withColumn("breaks", F.when(~broken, _breaks(c, r))), steps)
    curve, exact = F.col("curve"), F.col("exact")
    facts = facts.withColumns({"maximum_possible": F.try_element_at(curve, F.lit(-1))["at"], "minimum_possible": F.try_element_at(curve, F.lit(1))["at"]})
    high, low = F.col("maximum_possible"), F.col("minimum_possible")
    status = (
        F.when(broken, "incomplete_structure")
        .when(own.isNull() & bonus_own.isNull(), "unknown_item")
        .when(graded, "field_graded")
        .when(high.isNull(), "incomplete_structure")
        .when(high + 1e-8 < goal, "impossible")
        .when(low + 1e-8 >= goal, "guaranteed")
        .otherwise("achievable")
    )
    facts = facts.withColumn("status", status)
    # scores are entered in tenths: take the next one where rounding fell short
    checked = let(
        F.least(F.lit(100.0), F.ceil((exact - 1e-9) * 10) / 10).cast("double"),
        lambda x: F.when(F.coalesce(_on_curve(curve, x), F.lit(0.0)) + 1e-8 >= goal, x).otherwise(F.round(x + 0.1, 1)),
    )
    required = F.when(F.col("status") == "guaranteed", 0.0).when(F.col("status") == "achievable", checked)
    facts = facts.withColumn("required_score", required).drop("curve", "breaks", "exact")
    return facts.withColumn("status", F.when(F.col("required_score") > 100, "impossible").otherwise(F.col("status")))


def what_if(items: DataFrame, hypothetical: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(items with hypothetical scores in place, rejected hypothetical rows).

    Hypothetical scores are for known items and lie in 0..100; everything else is set aside.
    """
    keys = list(keys)
    known = items.select(*keys, "item").distinct().withColumn("known", F.lit(True))
    judged = hypothetical.join(known, [*keys, "item"], "left")
    valid = F.col("known").isNotNull() & F.coalesce(F.col("value").between(0, 100), F.lit(False)) & ~F.isnan("value")
    rejected = judged.where(~valid).drop("known")
    accepted = judged.where(valid).select(*keys, "item", "value")
    overlaid = items.join(accepted, [*keys, "item"], "left")
    return overlaid.withColumn("score", F.coalesce("value", "score")).drop("value"), rejected


# --- rules --------------------------------------------------------------------------------------------


def grade_item_ids(items: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds `item_key`: the slug of the name; later names with a taken slug get a hash suffix."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = items.withColumn("slug", F.when(slug == "", "grade").otherwise(slug))
    place = F.row_number().over(Window.partitionBy(*keys, "slug").orderBy(order))
    suffix = F.substring(F.sha1(F.col("name").cast("binary")), 1, 6)
    return named.withColumn("item_key", F.when(place == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", suffix))).drop("slug")


def grade_rules_validate(
    components: DataFrame, items: DataFrame, rules: DataFrame, extra: DataFrame, letters: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Violations of extracted grading rules as rows (keys, problem).

    `components`: component_id, name, weight, aggregation, drop_lowest, drop_highest. `items`:
    component_id, name, share. `rules`: source_name, target_name. `extra`: name, points. `letters`:
    letter, minimum.
    """
    keys = list(keys)
    tol = V.WEIGHT_TOLERANCE

    def found(df: DataFrame, condition: Column, problem: str) -> DataFrame:
        return df.where(condition).select(*keys, F.lit(problem).alias("problem"))

    def repeated(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys, *by).count().where("count > 1")

    lowered = F.lower(F.trim("name"))
    per = items.groupBy(*keys, "component_id").agg(
        F.count("*").alias("n_items"), F.count("share").alias("n_shares"), F.sum(F.col("share").cast("decimal(38,12)")).cast("double").alias("share_sum"),
        F.count_distinct(lowered).alias("n_names"), F.count_if(F.trim("name") == "").alias("blank"),
        F.count_if((F.col("share") <= 0) | (F.col("share") > 1)).alias("bad_shares"),
    )
    c = components.join(per, [*keys, "component_id"], "left")
    single = F.col("n_items") == 1
    drops = F.when(single, 0).otherwise(F.col("drop_lowest") + F.col("drop_highest"))
    negative = ~single & ((F.col("drop_lowest") < 0) | (F.col("drop_highest") < 0))
    weighted = F.col("aggregation") == "weighted"
    complete = (F.col("n_shares") == F.col("n_items")) & (F.abs(F.col("share_sum") - 1.0) <= tol)
    total = components.groupBy(*keys).agg(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("total"))

    sources = items.groupBy(*keys, lowered.alias("source_key")).agg(F.count("*").alias("n_sources"), F.min("component_id").alias("source_component"))
    targets = components.groupBy(*keys, lowered.alias("target_key")).agg(F.min("component_id").alias("target_component"))
    rule = rules.withColumns({"source_key": F.lower(F.trim("source_name")), "target_key": F.lower(F.trim("target_name"))})
    rule = rule.join(sources, [*keys, "source_key"], "left").join(targets, [*keys, "target_key"], "left")
    resolvable = (
        F.coalesce(F.col("n_sources") == 1, F.lit(False)) & F.col("target_component").isNotNull()
        & (F.col("source_component") != F.col("target_component"))
    )
    parts = [
        found(c, ~F.col("weight").between(0, 1), "component weight outside 0..1"),
        found(c, F.trim("name") == "", "component without a name"),
        found(repeated(components.withColumn("low", lowered), ["low"]), F.lit(True), "component name repeated"),
        found(c, ~F.col("aggregation").isin("equal", "weighted"), "unknown averaging method"),
        found(c, F.col("n_items").isNull(), "component without items"),
        found(c, (F.col("blank") > 0) | (F.col("n_names") < F.col("n_items")), "item name missing or repeated"),
        found(c, F.col("bad_shares") > 0, "item weight outside 0..1"),
        found(c, weighted & ~complete, "item weights incomplete"),
        found(c, (F.col("aggregation") == "equal") & (F.col("n_shares") > 0), "item weights on equal average"),
        found(c, negative | (drops >= F.col("n_items")), "drop rule invalid"),
        found(rule, ~resolvable, "replacement rule unresolved"),
        found(extra, F.trim(F.coalesce("name", F.lit(""))) == "", "extra credit without a name"),
        found(extra, (F.col("points") <= 0) | (F.col("points") > 100), "extra credit points invalid"),
        found(extra, F.col("points").isNull(), "note: extra credit value not stated"),
        found(letters, (F.trim("letter") == "") | ~F.col("minimum").between(0, 100), "letter threshold invalid"),
        found(repeated(letters, ["letter"]), F.lit(True), "letter repeated"),
        found(total, F.col("total") > 1 + tol, "note: weights exceed 100%"),
        found(total, F.col("total") < 1 - tol, "note: weights below 100%"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_extraction(extractions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest extraction per key by creation time."""
    return first_row(extractions, keys, [F.desc("created_at"), F.desc("extraction_id")])


def extraction_status(candidates: DataFrame, extractions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Status of each syllabus candidate: analyzed, its extraction's status, or not_analyzed.

    An extraction is reusable only while its rules still validate.
    """
    key = ["user_id", "course_id", "source_id", "text_hash"]
    last = latest_extraction(extractions, key).select(*key, F.col("status").alias("extracted"), "valid")
    agreed = confirmed.select("user_id", "course_id", F.col("text_hash").alias("confirmed_hash"))
    out = candidates.join(last, key, "left").join(agreed, ["user_id", "course_id"], "left")
    is_confirmed = F.coalesce(F.col("confirmed_hash") == F.col("text_hash"), F.lit(False))
    status = F.when(is_confirmed, "analyzed").otherwise(F.coalesce("extracted", F.lit("not_analyzed")))
    return out.withColumn("status", status).withColumn("reusable", F.coalesce("valid", F.lit(False))).drop("extracted", "valid", "confirmed_hash")
