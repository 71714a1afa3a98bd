"""Page text as column expressions: headings, running headers, block kinds, equations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions.common import any_case, let
from lectern.functions.text import words


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def roman_to_int(text: Column) -> Column:
    """Value of a Roman numeral, null for anything else."""
    letters = F.upper(strip(text))
    table = F.create_map(*[F.lit(x) for pair in V.ROMAN_VALUES.items() for x in pair])
    values = F.transform(F.reverse(F.split(letters, "")), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))

    def add(state: Column, v: Column) -> Column:
        signed = F.when(v < state["high"], -v).otherwise(v)
        return F.struct((state["total"] + signed).alias("total"), F.greatest(state["high"], v).alias("high"))

    return F.when(letters.rlike(f"^[{''.join(V.ROMAN_VALUES)}]+$"), F.aggregate(values, start, add, lambda s: s["total"]))


def plausible_heading(rest: Column) -> Column:
    """Whether the words after 'Chapter n' read as a title rather than as a sentence."""
    text = strip(rest)
    return (text == "") | ((F.length(text) <= V.HEADING_MAX_TITLE) & text.rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]"))


def running_header(line: Column) -> Column:
    text = strip(line)
    number = text.rlike(r"^\d{1,%d}$" % V.PAGE_NUMBER_MAX_DIGITS)
    capitals = (
        (F.length(text) < V.RUNNING_HEADER_MAX)
        & (F.regexp_count(text, F.lit(r"\p{L}")) >= V.RUNNING_HEADER_MIN_LETTERS)
        & ~text.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    )
    return number | capitals


def needs_ocr(text: Column) -> Column:
    return F.length(strip(text)) < V.EMPTY_PAGE_CHARS


def _display(s: Column) -> Column:
    parts = words(s)
    n = F.size(parts)
    wordy = F.size(F.filter(parts, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$")))
    return (
        (F.length(s) > 0) & (F.length(s) < 120) & s.rlike(V.EQUATION_RELATION)
        & (n <= 14) & (wordy <= F.greatest(F.lit(2), F.floor(n / 3)))
    )


def display_equation(line: Column) -> Column:
    """A short line with a relation and few ordinary words."""
    return let(strip(line), _display)


def _continues(s: Column) -> Column:
    return (F.length(s) <= V.EQUATION_CONTINUATION_MAX) & s.rlike(V.EQUATION_CONTINUATION) & s.rlike("[A-Za-z0-9}]")


def line_kind(line: Column) -> Column:
    """What a line can be to the equations around it: 1 begins one, 2 may belong to the one above it, 4 is a bare number."""

    def test(s: Column) -> Column:
        begins, number = _display(s), s.rlike(V.EQUATION_NUMBER)
        return F.when(number, F.when(begins, 5).otherwise(4)).when(begins, 3).when(_continues(s), 2).otherwise(0)

    return let(strip(line), test)


def block_kind(text: Column) -> Column:
    def test(s: Column) -> Column:
        # most bodies are one line: no table, and nothing to split
        several = F.contains(s, F.lit("\n"))
        lines = F.filter(F.split(s, "\n"), lambda x: strip(x) != "")
        n = F.when(several, F.size(lines)).otherwise(1)
        tabular = F.size(F.filter(lines, lambda x: x.rlike(V.BLOCK_TABLE_LINE)))
        operators = F.length(s) - F.length(F.translate(s, V.EQUATION_OPERATORS, ""))
        equation = (
            (F.length(s) < 400) & s.rlike(V.BLOCK_EQUATION_HINT) & (n <= 3)
            & (s.rlike("(?s)" + V.BLOCK_EQUATION) | (operators >= 2))
        )
        return (
            F.when(s == "", "prose")
            .when(s.rlike(any_case(V.BLOCK_DEFINITION)), "definition")
            .when(several & (tabular >= F.greatest(F.lit(2.0), n * 0.6)), "table")
            .when(equation, "equation")
            .otherwise("prose")
        )

    return let(strip(text), test)


# --- mathematical notation -------------------------------------------------------------------

_LETTER = r"(?<![A-Za-z\\])([A-Za-z])"


def normalise_tex(text: Column) -> Column:
    """Subscripts, exponents and relation signs in TeX form."""
    out = strip(text)
    for pattern, replacement in (
        (_LETTER + r"([0-9])(?=[A-Za-z0-9(=+−*/ }.,;]|$)", r"$1_{$2}"),
        (_LETTER + r"_([A-Za-z0-9])", r"$1_{$2}"),
        (_LETTER + r"\^([A-Za-z0-9])", r"$1^{$2}"),
    ):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    for sign, name in (("≤", "\\le "), ("≥", "\\ge "), ("≠", "\\ne "), ("×", "\\times ")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    out = F.regexp_replace(out, F.lit(r"(?<!\\)\bfrac\s*\{"), F.lit(r"\\frac{"))
    return F.regexp_replace(out, F.lit(r"[ \t]{2,}"), F.lit(" "))


def looks_like_equation(text: Column) -> Column:
    sign = r"[=≤≥<>≠≈∑∫]|\\(?:frac|sum|sqrt|alpha|beta)|\^[A-Za-z0-9{]|_[A-Za-z0-9{]"
    return (
        (text != "") & (F.length(text) < 240) & ~F.contains(text, F.lit(":"))
        & (F.regexp_count(text, F.lit(r"\b[A-Za-z]{4,}\b")) <= 2) & text.rlike(sign)
    )


_SPAN = (
    r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|"
    r"(?<!\$)\$(?!\s)(?=[^$\n]*(?:\\[A-Za-z]+|[=^_+*/]|\b[A-Za-z]\b))[^$\n]+?\$"
)


def canonical_math(text: Column) -> Column:
    """Explicit math spans and equation-like lines in one notation; prose is left alone."""

    mark = "\u0001"
    # cut the text at its math spans: pieces between marks alternate prose and span
    cut = F.split(F.regexp_replace(text, F.lit("(?s)(" + _SPAN + ")"), F.lit(mark + "$1" + mark)), mark)

    def normalise(piece: Column, i: Column) -> Column:
        body2 = normalise_tex(F.substring(piece, F.lit(3), F.length(piece) - 4))
        body1 = normalise_tex(F.substring(piece, F.lit(2), F.length(piece) - 2))
        fixed = (
            F.when(piece.startswith("\\["), F.concat(F.lit("\\["), body2, F.lit("\\]")))
            .when(piece.startswith("\\("), F.concat(F.lit("\\("), body2, F.lit("\\)")))
            .when(piece.startswith("$$"), F.concat(F.lit("$$"), body2, F.lit("$$")))
            .otherwise(F.concat(F.lit("\\("), body1, F.lit("\\)")))
        )
        return F.when(i % 2 == 1, fixed).otherwise(piece)

    marked = F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\"))
    spanned = F.when(marked, F.array_join(F.transform(cut, normalise), "")).otherwise(text)

    def line(raw: Column) -> Column:
        def fix(s: Column) -> Column:
            lead, tail = F.split_part(s, F.lit(":"), F.lit(1)), F.regexp_extract(s, "(?s)^[^:]*:(.*)$", 1)
            wrapped = s.rlike(r"(?s)^(?:\\\[|\\\(|\$\$).*(?:\\\]|\\\)|\$\$)$")
            labelled = F.contains(s, F.lit(":")) & looks_like_equation(strip(tail))
            return (
                F.when(labelled, F.concat(lead, F.lit(": \\("), normalise_tex(tail), F.lit("\\)")))
                .when(~wrapped & looks_like_equation(s), F.concat(F.lit("\\["), normalise_tex(s), F.lit("\\]")))
                .otherwise(raw)
            )

        return let(strip(raw), fix)

    return F.array_join(F.transform(F.split(spanned, "\n"), line), "\n")
