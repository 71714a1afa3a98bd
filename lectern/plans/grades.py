"""Grade-book queries: every order is one student's course, its line items are the scores."""

from pyspark.sql import functions as F


from lectern.functions.common import spread
from lectern.operators import grades as G

from lectern.plans.registry import query

KEY = ["student"]


def books_of(t, items=None):
    return G.build_books(t("grade_components_v"), items if items is not None else t("grade_items_v"), t("grade_extra_v"), t("grade_rules_v"), KEY)


def results_sql(items: str = "grade_items_v", of: str = "", components: str = "grade_components_v", extra: str = "grade_extra_v", rules: str = "grade_rules_v") -> str:
    """CTEs up to {of}book, a row for each student, over the given tables; `of` sets several apart."""
    return f"""
{of}low AS (SELECT student, MIN(score) AS low, COUNT(*) = COUNT(score) AS complete FROM {items} WHERE component = 'A' GROUP BY student),
{of}place AS (SELECT l.student, MIN(i.item) AS item FROM {of}low l JOIN {items} i ON i.student = l.student AND i.component = 'A' AND i.score = l.low GROUP BY ALL),
{of}swap AS (SELECT r.student, src.score AS incoming, p.item
  FROM {rules} r JOIN {of}low l USING (student) JOIN {of}place p USING (student) JOIN {items} src ON src.student = r.student AND src.item = r.source_item
  WHERE l.complete AND src.score IS NOT NULL AND (NOT r.if_higher OR src.score > l.low)),
{of}sc AS (SELECT i.student, i.component, i.item, i.share, CASE WHEN s.item IS NOT NULL THEN s.incoming ELSE i.score END AS score FROM {items} i LEFT JOIN {of}swap s ON s.student = i.student AND s.item = i.item AND i.component = 'A'),
{of}n AS (SELECT student, component, COUNT(*) AS n_items, COUNT(score) AS n_known FROM {of}sc GROUP BY ALL),
{of}o AS (SELECT *, row_number() OVER (PARTITION BY student, component ORDER BY score, item) AS up, row_number() OVER (PARTITION BY student, component ORDER BY score DESC, item DESC) AS down FROM {of}sc WHERE score IS NOT NULL),
{of}k AS (SELECT c.student, c.component, c.weight, c.aggregation, n.n_items, n.n_known, n.n_items = n.n_known AS complete, CASE WHEN n.n_items = n.n_known THEN c.drop_lowest + c.drop_highest ELSE 0 END AS dropped, c.drop_lowest, c.drop_highest FROM {components} c JOIN {of}n n USING (student, component)),
{of}cnt AS (SELECT student, component, COUNT(*) FILTER (NOT complete OR (up > drop_lowest AND down > drop_highest)) AS n_counted, SUM(score) FILTER (NOT complete OR (up > drop_lowest AND down > drop_highest)) AS plain, SUM(score * share) FILTER (NOT complete OR (up > drop_lowest AND down > drop_highest)) AS mass, SUM(share) FILTER (NOT complete OR (up > drop_lowest AND down > drop_highest)) AS share
  FROM (SELECT k.*, o.score, o.share, o.up, o.down FROM {of}k k JOIN {of}o o USING (student, component)) GROUP BY ALL),
{of}cat AS (SELECT k.student, k.component AS name, k.weight, k.complete AND n_known > 0 AS complete, CASE WHEN n_known > 0 THEN CASE WHEN aggregation = 'weighted' THEN mass / nullif(share, 0) ELSE plain / nullif(n_counted, 0) END END AS average,
    CASE WHEN n_known = 0 THEN 0 ELSE k.weight * CASE WHEN aggregation = 'weighted' THEN least(1.0, share) ELSE coalesce(n_counted::DOUBLE / nullif(n_items - dropped, 0), 0) END END AS completed_weight FROM {of}k k LEFT JOIN {of}cnt USING (student, component)),
{of}bonus AS (SELECT student, SUM(points * coalesce(score, 0) / 100) AS bonus FROM {extra} GROUP BY student),
{of}crs AS (SELECT c.student, SUM(completed_weight * coalesce(average, 0) / 100) + coalesce(ANY_VALUE(b.bonus), 0) / 100 AS earned, coalesce(ANY_VALUE(b.bonus), 0) AS extra_points, SUM(completed_weight) AS done, SUM(weight) AS w, bool_and(complete) AS complete FROM {of}cat c LEFT JOIN {of}bonus b USING (student) GROUP BY c.student),
{of}book AS (SELECT student, earned * 100 AS earned, extra_points, done AS completed_weight, greatest(0, 1 - w) AS unallocated_weight, CASE WHEN done <> 0 THEN earned / done * 100 END AS current_percent,
    CASE WHEN abs(w - 1) <= 0.00001 AND complete THEN earned * 100 + greatest(0, 1 - done) * 100 END AS projected_percent FROM {of}crs)"""


def curve_sql(cases: str, score: str, bonus: str) -> str:
    """CTE curve (student, assumption, curve): the projection over a score x of the open parts, in straight segments.

    `cases` has the rows (student, assumption, item_id) to project; `score` and `bonus` say what an open item and open
    extra credit get at x. Each break and two points of each segment are scenarios, books of their own.
    """
    return f"""
cases AS ({cases}),
brk AS (SELECT DISTINCT student, unnest([0.0::DOUBLE, score, 100.0::DOUBLE]) AS lo FROM grade_items_v),
seg AS (SELECT student, lo, lead(lo) OVER (PARTITION BY student ORDER BY lo) - lo AS width FROM brk WHERE lo = 0 OR lo = 100 OR (lo > 0 AND lo < 100)),
scen AS (SELECT student AS owner, assumption, item_id, lo, p, lo + coalesce(width, 0) * p AS x, coalesce(width, 0) AS width, row_number() OVER () AS sid FROM cases JOIN seg USING (student), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.75::DOUBLE)) v(p)),
s_items AS MATERIALIZED (SELECT sid AS student, component, item, share, coalesce(score, {score}) AS score FROM scen JOIN grade_items_v g ON g.student = owner),
s_comp AS MATERIALIZED (SELECT sid AS student, g.* EXCLUDE (student) FROM scen JOIN grade_components_v g ON g.student = owner),
s_rules AS MATERIALIZED (SELECT sid AS student, g.* EXCLUDE (student) FROM scen JOIN grade_rules_v g ON g.student = owner),
s_extra AS MATERIALIZED (SELECT sid AS student, item, points, coalesce(score, {bonus}) AS score FROM scen JOIN grade_extra_v g ON g.student = owner LEFT JOIN opened USING (owner)),
{results_sql('s_items', 's_', 's_comp', 's_extra', 's_rules')},
flat AS (SELECT owner AS student, assumption, lo, any_value(width) AS width, any_value(projected_percent) FILTER (p = 0) AS y0, any_value(projected_percent) FILTER (p = 0.25) AS ya, any_value(projected_percent) FILTER (p = 0.75) AS yb
   FROM scen LEFT JOIN s_book b ON b.student = sid GROUP BY owner, assumption, lo),
curve AS (SELECT student, assumption, list({{'lo': lo, 'y0': round(y0, 9), 'mid': lo + width * 0.25, 'value': ya, 'slope': CASE WHEN width > 0 THEN (yb - ya) / (width * 0.5) ELSE 0 END}} ORDER BY lo) AS curve FROM flat GROUP BY ALL)"""


def on_curve_sql(x: str) -> str:
    here = f"list_filter(curve, lambda c: c.lo <= {x})[-1]"
    return f"CASE WHEN {here}.lo = {x} THEN {here}.y0 ELSE round({here}.value + {here}.slope * ({x} - {here}.mid), 9) END"


def halving_sql(reached: str, steps: int) -> str:
    """CTE solved (student, assumption, target, hi) from asked (student, assumption, target); `reached` is over y."""
    y = "CASE WHEN l.lo = mid THEN l.y0 ELSE round(l.value + l.slope * (mid - l.mid_x), 9) END"
    return f"""
lines AS (SELECT student, assumption, lo, lo + CASE WHEN width > 0 THEN width ELSE 1 END AS up_to, round(y0, 9) AS y0, lo + width * 0.25 AS mid_x, ya AS value, CASE WHEN width > 0 THEN (yb - ya) / (width * 0.5) ELSE 0 END AS slope FROM flat),
halving AS (SELECT student, assumption, target, 0 AS step, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 50.0::DOUBLE AS mid FROM asked
  UNION ALL SELECT student, assumption, target, step + 1, lo, hi, (lo + hi) / 2 FROM
    (SELECT student, assumption, target, step, CASE WHEN ok THEN lo ELSE mid END AS lo, CASE WHEN ok THEN mid ELSE hi END AS hi
     FROM (SELECT *, coalesce({reached}, false) AS ok FROM (SELECT h.*, {y} AS y FROM halving h JOIN lines l ON h.student = l.student AND h.assumption = l.assumption AND h.mid >= l.lo AND h.mid < l.up_to WHERE h.step < {steps})))),
solved AS (SELECT student, assumption, target, hi FROM halving WHERE step = {steps})"""


OPENED = """opened AS (SELECT student AS owner, COUNT(*) - COUNT(score) AS open_items FROM grade_items_v GROUP BY student)"""


def target_sql(letters: str) -> str:
    """CTE answers (student, letter, target, status, required, maximum_possible, open_items, open_extra) for the rows of `letters`."""
    top = results_sql("t_items", "t_", extra="t_extra")
    return f"""{results_sql()}, {OPENED}, {curve_sql("SELECT DISTINCT student, '' AS assumption, NULL::BIGINT AS item_id FROM grade_items_v", 'x', 'CASE WHEN open_items = 0 THEN x END')},
t_items AS (SELECT * REPLACE (coalesce(score, 100) AS score) FROM grade_items_v), t_extra AS (SELECT * REPLACE (coalesce(score, 100) AS score) FROM grade_extra_v), {top},
bonuses AS (SELECT student, COUNT(*) - COUNT(score) AS open_extra, COUNT(*) > COUNT(points) AS unvalued FROM grade_extra_v GROUP BY student),
asked AS (SELECT student, assumption, target, letter, curve FROM curve, ({letters}) l), {halving_sql('y >= target', 50)},
facts AS (SELECT a.student, a.letter, a.target, a.curve[1].y0 AS minimum, t.projected_percent AS maximum, b.current_percent AS current, o.open_items::INTEGER AS open_items, coalesce(x.open_extra, 0)::INTEGER AS open_extra,
    abs(c.w - 1) > 0.00001 OR coalesce(x.unvalued, false) AS broken, s.hi
  FROM asked a JOIN solved s USING (student, target) JOIN t_book t USING (student) JOIN book b USING (student) JOIN crs c USING (student) JOIN opened o ON o.owner = a.student LEFT JOIN bonuses x USING (student)),
judged AS (SELECT *, open_items = 0 AND open_extra = 0 AS closed, CASE WHEN broken THEN 'incomplete_structure' WHEN open_items = 0 AND open_extra = 0 THEN CASE WHEN current >= target THEN 'achieved' ELSE 'impossible' END
    WHEN maximum + 1e-8 < target THEN 'impossible' WHEN minimum + 1e-8 >= target THEN 'guaranteed' WHEN open_items = 0 THEN 'extra_credit_only' ELSE 'achievable' END AS status FROM facts),
answers AS (SELECT student, letter, target, status, round(CASE status WHEN 'guaranteed' THEN 0 WHEN 'achievable' THEN hi WHEN 'extra_credit_only' THEN hi END, 6) AS required,
    round(CASE WHEN NOT broken THEN CASE WHEN closed THEN current ELSE maximum END END, 6) AS maximum_possible, open_items, open_extra FROM judged)"""


def letter_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN round({x}, 9) >= {m} THEN '{name}'" for name, m in G.DEFAULT_SCALE) + " END"


BOOK = ", ".join(f"round({c}, 6) AS {c}" for c in ("earned", "extra_points", "completed_weight", "unallocated_weight", "current_percent", "projected_percent"))


def rounded(df):
    from pyspark.sql.types import DoubleType

    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields if isinstance(f.dataType, DoubleType)})


@query("grade_replacement", f"WITH {results_sql()} SELECT student, component, item, round(score, 6) AS score FROM sc")
def grade_replacement(t):
    """Every item's score after the replacement rules."""
    swapped = G.replace_lowest(F.col("components"), F.col("rules"))
    rows = books_of(t).select("student", F.explode(swapped).alias("c")).select("student", F.col("c.name").alias("component"), F.explode("c.items").alias("i"))
    return rows.select("student", "component", F.col("i.item").cast("long").alias("item"), F.round("i.score", 6).alias("score"))


@query("grade_drops", f"WITH {results_sql()} SELECT student, name, complete, round(average, 6) AS average, round(completed_weight, 6) AS completed_weight FROM cat")
def grade_drops(t):
    return rounded(G.category_results(books_of(t), KEY)).select("student", "name", "complete", "average", "completed_weight")


@query("gradebook", f"WITH {results_sql()} SELECT student, {BOOK}, {letter_sql('current_percent')} AS current_letter, {letter_sql('projected_percent')} AS projected_letter FROM book")
def gradebook(t):
    return rounded(G.gradebook(books_of(t), KEY))


@query("letter_grade", """WITH p AS (SELECT student, AVG(score) AS percent FROM scores_v GROUP BY student), s AS (SELECT DISTINCT student, component AS letter, CASE component WHEN 'A' THEN 70 WHEN 'N' THEN 45 ELSE 20 END::DOUBLE AS minimum FROM scores_v)
    SELECT p.student, round(p.percent, 6) AS percent, (SELECT arg_max(letter, minimum) FROM s WHERE s.student = p.student AND s.minimum <= p.percent) AS letter FROM p""")
def letter_grade(t):
    """Scales as a table: each student's course has thresholds for the letters it uses."""
    s = t("scores_v")
    percents = s.groupBy("student").agg(F.avg("score").alias("percent"))
    minimum = F.when(F.col("component") == "A", 70.0).when(F.col("component") == "N", 45.0).otherwise(20.0)
    scale = s.select("student", F.col("component").alias("letter"), minimum.alias("minimum")).distinct()
    return G.letter_grade(percents, scale, KEY).withColumn("percent", F.round("percent", 6))


@query("grade_target", f"WITH {target_sql('SELECT NULL AS letter, 60.0::DOUBLE AS target')} SELECT student, target, status, required, maximum_possible, open_items, open_extra FROM answers")
def grade_target(t):
    books = spread(books_of(t), *KEY).withColumn("target", F.lit(60.0))
    return rounded(G.solve_target(books).select("student", "target", "status", "required", "maximum_possible", "open_items", "open_extra"))


LETTERS = " UNION ALL ".join(f"SELECT '{name}' AS letter, {minimum}::DOUBLE AS target" for name, minimum in G.DEFAULT_SCALE)


@query("grade_ladder", f"WITH {target_sql(LETTERS)} SELECT student, letter, target, status, required, maximum_possible FROM answers")
def grade_ladder(t):
    return rounded(G.grade_ladder(spread(books_of(t), *KEY)).select("student", "letter", "target", "status", "required", "maximum_possible"))


ITEM_CASES = """SELECT student, unnest(['same_score', 'zero', 'hundred']) AS assumption, MIN(item) AS item_id FROM grade_items_v WHERE score IS NULL GROUP BY student"""
OTHERS = "CASE assumption WHEN 'zero' THEN 0.0 WHEN 'hundred' THEN 100.0 ELSE x END"


@query("grade_item_target", f"""WITH {results_sql()}, {OPENED}, {curve_sql(ITEM_CASES, f'CASE WHEN item = item_id THEN x ELSE {OTHERS} END', OTHERS)},
    asked AS (SELECT student, assumption, 55.0::DOUBLE AS target, curve FROM curve), {halving_sql('y + 1e-10 >= target', 60)},
    tenths AS (SELECT student, assumption, target, curve, least(100.0, ceil((hi - 1e-9) * 10) / 10) AS x FROM asked JOIN solved USING (student, assumption, target)),
    facts AS (SELECT t.student, t.assumption, i.item_id, target, curve[1].y0 AS low, curve[-1].y0 AS high, CASE WHEN coalesce({on_curve_sql('x')}, 0) + 1e-8 >= target THEN x ELSE round(x + 0.1, 1) END AS tenth, abs(c.w - 1) > 0.00001 AS broken
      FROM tenths t JOIN cases i USING (student, assumption) JOIN crs c USING (student)),
    judged AS (SELECT *, CASE WHEN broken OR high IS NULL THEN 'incomplete_structure' WHEN high + 1e-8 < target THEN 'impossible' WHEN low + 1e-8 >= target THEN 'guaranteed' ELSE 'achievable' END AS status FROM facts),
    scored AS (SELECT *, CASE status WHEN 'guaranteed' THEN 0.0 WHEN 'achievable' THEN tenth END AS required FROM judged)
    SELECT student, item_id, assumption, CASE WHEN required > 100 THEN 'impossible' ELSE status END AS status, round(required, 6)::DOUBLE AS required_score,
           round(CASE WHEN NOT broken THEN low END, 6) AS minimum_possible, round(CASE WHEN NOT broken THEN high END, 6) AS maximum_possible FROM scored""")
def grade_item_target(t):
    """The first open item of each student, under each assumption about the other open ones."""
    first = t("grade_items_v").where("score IS NULL").groupBy("student").agg(F.min("item").alias("item_id"))
    assumption = F.explode(F.array(F.lit("same_score"), F.lit("zero"), F.lit("hundred")))
    books = spread(books_of(t), *KEY).join(first, KEY).withColumns({"target": F.lit(55.0), "assumption": assumption})
    out = G.solve_item_target(books)
    return rounded(out.select("student", F.col("item_id").cast("long").alias("item_id"), "assumption", "status", "required_score", "minimum_possible", "maximum_possible"))


WHAT_IF = "wi AS (SELECT i.student, i.component, i.item, i.share, CASE WHEN h.value BETWEEN 0 AND 100 THEN h.value ELSE i.score END AS score FROM grade_items_v i LEFT JOIN hypothetical_v h USING (student, item)), bad AS (SELECT h.student, COUNT(*) AS rejected FROM hypothetical_v h LEFT JOIN grade_items_v i USING (student, item) WHERE i.item IS NULL OR NOT h.value BETWEEN 0 AND 100 GROUP BY h.student)"


@query("grade_what_if", f"WITH {WHAT_IF}, {results_sql('wi')} SELECT student, {BOOK}, {letter_sql('current_percent')} AS current_letter, {letter_sql('projected_percent')} AS projected_letter, coalesce(rejected, 0) AS rejected FROM book LEFT JOIN bad USING (student)")
def grade_what_if(t):
    items, rejected = G.what_if(t("grade_items_v"), t("hypothetical_v"), KEY)
    counts = rejected.groupBy(*KEY).agg(F.count("*").alias("rejected"))
    out = rounded(G.gradebook(books_of(t, items), KEY)).join(counts, KEY, "left")
    return out.withColumn("rejected", F.coalesce("rejected", F.lit(0)))


# --- rules ------------------------------------------------------------------------------------------


@query("grade_item_ids", """WITH s AS (SELECT student, item, name, CASE WHEN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'grade' ELSE regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug FROM rule_items_v)
    SELECT student, item, name, CASE WHEN row_number() OVER (PARTITION BY student, slug ORDER BY item) = 1 THEN slug ELSE slug || '_' || substr(sha1(name), 1, 6) END AS item_key FROM s""")
def grade_item_ids(t):
    out = G.grade_item_ids(t("rule_items_v").select("student", "item", "name"), KEY, "item")
    return out.withColumn("item", F.col("item").cast("long"))


@query("grade_rules_validate", """WITH ex AS (SELECT student, CASE WHEN student % 16 = 0 THEN '' ELSE 'Bonus' END AS name, CASE WHEN student % 12 = 0 THEN NULL WHEN student % 20 = 0 THEN 150 ELSE points END AS points FROM grade_extra_v),
    per AS (SELECT student, component_id, COUNT(*) AS n, COUNT(share) AS ns, CAST(SUM(CAST(share AS DECIMAL(38,12))) AS DOUBLE) AS ss, COUNT(DISTINCT lower(trim(name))) AS nn, COUNT(*) FILTER (trim(name) = '') AS blank, COUNT(*) FILTER (share <= 0 OR share > 1) AS bad FROM rule_items_v GROUP BY ALL),
    c AS (SELECT rc.*, per.* EXCLUDE (student, component_id) FROM rule_components_v rc LEFT JOIN per USING (student, component_id)),
    tot AS (SELECT student, CAST(SUM(CAST(weight AS DECIMAL(38,12))) AS DOUBLE) AS total FROM rule_components_v GROUP BY student),
    src AS (SELECT student, lower(trim(name)) AS sk, COUNT(*) AS n, MIN(component_id) AS sc FROM rule_items_v GROUP BY ALL), tgt AS (SELECT student, lower(trim(name)) AS tk, MIN(component_id) AS tc FROM rule_components_v GROUP BY ALL)
    SELECT student, 'component weight outside 0..1' AS problem FROM c WHERE NOT weight BETWEEN 0 AND 1
    UNION ALL SELECT student, 'component without a name' FROM c WHERE trim(name) = ''
    UNION ALL SELECT student, 'component name repeated' FROM rule_components_v GROUP BY student, lower(trim(name)) HAVING COUNT(*) > 1
    UNION ALL SELECT student, 'unknown averaging method' FROM c WHERE aggregation NOT IN ('equal', 'weighted')
    UNION ALL SELECT student, 'component without items' FROM c WHERE n IS NULL
    UNION ALL SELECT student, 'item name missing or repeated' FROM c WHERE blank > 0 OR nn < n
    UNION ALL SELECT student, 'item weight outside 0..1' FROM c WHERE bad > 0
    UNION ALL SELECT student, 'item weights incomplete' FROM c WHERE aggregation = 'weighted' AND NOT coalesce(ns = n AND abs(ss - 1) <= 0.00001, false)
    UNION ALL SELECT student, 'item weights on equal average' FROM c WHERE aggregation = 'equal' AND ns > 0
    UNION ALL SELECT student, 'drop rule invalid' FROM c WHERE n > 1 AND (drop_lowest < 0 OR drop_highest < 0 OR drop_lowest + drop_highest >= n)
    UNION ALL SELECT r.student, 'replacement rule unresolved' FROM rule_replacements_v r LEFT JOIN src ON src.student = r.student AND sk = lower(trim(source_name)) LEFT JOIN tgt ON tgt.student = r.student AND tk = lower(trim(target_name))
      WHERE NOT (coalesce(n = 1, false) AND tc IS NOT NULL AND coalesce(sc <> tc, false))
    UNION ALL SELECT student, 'extra credit without a name' FROM ex WHERE trim(name) = '' UNION ALL SELECT student, 'extra credit points invalid' FROM ex WHERE points <= 0 OR points > 100
    UNION ALL SELECT student, 'note: extra credit value not stated' FROM ex WHERE points IS NULL
    UNION ALL SELECT student, 'letter threshold invalid' FROM rule_letters_v WHERE trim(letter) = '' OR NOT minimum BETWEEN 0 AND 100
    UNION ALL SELECT student, 'letter repeated' FROM rule_letters_v GROUP BY student, letter HAVING COUNT(*) > 1
    UNION ALL SELECT student, 'note: weights exceed 100%' FROM tot WHERE total > 1.00001 UNION ALL SELECT student, 'note: weights below 100%' FROM tot WHERE total < 0.99999""")
def grade_rules_validate(t):
    extra = t("grade_extra_v").selectExpr(
        "student", "CASE WHEN student % 16 = 0 THEN '' ELSE 'Bonus' END AS name", "CASE WHEN student % 12 = 0 THEN NULL WHEN student % 20 = 0 THEN 150D ELSE points END AS points"
    )
    return G.grade_rules_validate(t("rule_components_v"), t("rule_items_v"), t("rule_replacements_v"), extra, t("rule_letters_v"), KEY)


# --- extractions -----------------------------------------------------------------------------------------

_EXTRACTIONS = """SELECT event_id AS extraction_id, concat('u', user_id % 20) AS user_id, concat('c', user_id % 7) AS course_id, event_type AS source_id,
    CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'failed' END AS status, event_id % 5 <> 0 AS valid, ts AS created_at FROM {events}"""


@query("latest_extraction", f"SELECT user_id, course_id, source_id, extraction_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, course_id, source_id ORDER BY created_at DESC, extraction_id DESC) AS n FROM ({_EXTRACTIONS.replace('{', '').replace('}', '')})) WHERE n = 1")
def latest_extraction(t):
    rows = t.spark.sql(_EXTRACTIONS, events=t("events"))
    return G.latest_extraction(rows, ["user_id", "course_id", "source_id"]).select("user_id", "course_id", "source_id", "extraction_id", "status")


_HASHED = """SELECT page_id, user_id, course_id, concat('s', page_id % 40) AS source_id, md5(content) AS text_hash FROM {files_v}"""
_FOUND = """SELECT page_id AS extraction_id, user_id, course_id, source_id, text_hash, CASE page_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'failed' END AS status, page_id % 2 = 0 AS valid, page_id AS created_at FROM {hashed} WHERE page_id % 3 <> 0"""


@query("extraction_status", f"""WITH hashed AS ({_HASHED.replace('{', '').replace('}', '')}), found AS ({_FOUND.replace('{', '').replace('}', '')}),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, course_id, source_id, text_hash ORDER BY created_at DESC, extraction_id DESC) AS n FROM found) WHERE n = 1),
    conf AS (SELECT user_id, course_id, MAX(text_hash) AS confirmed_hash FROM hashed GROUP BY ALL)
    SELECT h.page_id, h.user_id, h.course_id, CASE WHEN coalesce(confirmed_hash = h.text_hash, false) THEN 'analyzed' ELSE coalesce(l.status, 'not_analyzed') END AS status, coalesce(l.valid, false) AS reusable
    FROM hashed h LEFT JOIN last l ON l.user_id = h.user_id AND l.course_id = h.course_id AND l.source_id = h.source_id AND l.text_hash = h.text_hash LEFT JOIN conf c ON c.user_id = h.user_id AND c.course_id = h.course_id""")
def extraction_status(t):
    hashed = t.spark.sql(_HASHED, files_v=t("files_v"))
    found = t.spark.sql(_FOUND, hashed=hashed)
    confirmed = hashed.groupBy("user_id", "course_id").agg(F.max("text_hash").alias("text_hash"))
    return G.extraction_status(hashed, found, confirmed).select("page_id", "user_id", "course_id", "status", "reusable")
