"""Page text to blocks, parents and child chunks.

A document is one row, so everything here is partitioned by document: no step holds more than one
document, and only the greedy fills run in Python, over small integer arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import fixed_values as V
from lectern.functions import pages as P
from lectern.functions import text as X
from lectern.functions.common import once

_RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fill_groups(sizes: pd.Series, breaks: pd.Series, limit: pd.Series) -> pd.Series:
    """Group number of each element when groups are filled in order up to `limit`.

    A change of `breaks` also starts a group; an element above the limit has a group of its own.
    """

    def assign(values, marks, cap):
        out, group, used = [], 0, 0
        for i, (size, mark) in enumerate(zip(values, marks)):
            if i and (mark != marks[i - 1] or used + size > cap):
                group, used = group + 1, 0
            used += size
            out.append(group)
        return out

    return pd.Series([assign(s, b, c) for s, b, c in zip(sizes, breaks, limit)])


@F.pandas_udf(_RANGES)
def fill_ranges(sizes: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    """Index ranges of consecutive elements within `limit`, each repeating up to `overlap` of the last."""

    def ranges(values, cap, shared):
        out, first, used = [], 0, 0
        for i, size in enumerate(values):
            if i > first and used + size > cap:
                out.append({"first": first, "last": i - 1})
                start, used = i, 0
                while start > first and used + values[start - 1] <= shared:
                    start -= 1
                    used += values[start]
                first = start
            used += size
        if len(values):
            out.append({"first": first, "last": len(values) - 1})
        return out

    return pd.Series([ranges(list(s), c, o) for s, c, o in zip(sizes, limit, overlap)])


_BLOCKS = T.ArrayType(T.StructType([*_RANGES.elementType.fields, T.StructField("equation", T.BooleanType())]))


@F.pandas_udf(_BLOCKS)
def line_blocks(kinds: pd.Series) -> pd.Series:
    """Index ranges of a paragraph's lines that are one block each, from the lines' `line_kind`; no kinds are one line of prose.

    An equation starts at a display line and takes the mathematical rows that follow, plus one bare equation number.
    """

    def blocks(values):
        out, seen, inside, took = [], False, False, False
        for i, kind in enumerate(values):
            follows = bool(kind & 2)
            seen = bool(kind & 1) or (seen and follows)
            takes = bool(kind & 4) and inside
            inside = follows and seen
            equation = inside or takes
            if out and out[-1]["equation"] == equation and not (took and equation):
                out[-1]["last"] = i
            else:
                out.append({"first": i, "last": i, "equation": equation})
            took = takes
        return out or [{"first": 0, "last": 0, "equation": False}]

    return pd.Series([blocks(list(v)) for v in kinds])


def page_blocks(pages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, para, block, kind, body): paragraphs with their display equations lifted out.

    A paragraph's lines stay in its row, so nothing is shuffled; only their kinds, small numbers, pass Python.
    """
    paras = pages.select(*keys, F.posexplode(F.split(text, r"\n\s*\n")).alias("para", "para_text"))
    paras = once(paras, parts=F.split(P.strip(F.col("para_text")), "\n")).drop("para_text").where((F.size("parts") > 1) | (F.col("parts")[0] != ""))
    kinds = F.when(F.size("parts") > 1, F.transform("parts", P.line_kind)).otherwise(F.array().cast("array<int>"))
    blocks = paras.select(*keys, "para", "parts", F.posexplode(line_blocks(kinds)).alias("block", "z"))
    lines = F.slice("parts", F.col("z.first") + 1, F.col("z.last") - F.col("z.first") + 1)
    rows = F.array_join(F.transform(lines, P.strip), " ")
    body = F.when(F.col("z.equation"), rows).otherwise(P.strip(F.array_join(lines, "\n")))
    out = once(blocks, body=body).where("body <> ''")
    kind = F.when(F.col("z.equation"), "equation").otherwise(P.block_kind(F.col("body")))
    return out.select(*keys, "para", F.col("block").cast("long").alias("block"), "body", kind.alias("kind"))


def segment_blocks(segments: DataFrame, keys: Sequence[str], seg: str = "seg") -> DataFrame:
    """Blocks of each segment in document order, equations in normal notation: adds `block_no`."""
    blocks = page_blocks(segments, [*keys, seg])
    flat = F.regexp_replace("body", "\n", " ")
    body = F.when(F.col("kind") == "equation", P.canonical_math(flat)).otherwise(F.col("body"))
    order = Window.partitionBy(*keys).orderBy(seg, "para", "block")
    return blocks.withColumn("body", body).withColumn("block_no", F.row_number().over(order) - 1)


def split_prose(text: Column, limit: int, overlap: int) -> Column:
    """Pieces of a prose text within `limit` tokens, cut at sentence ends; none of a text that is null."""
    parts = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(X.sentences(text))
    sizes = F.transform(parts, X.token_estimate)
    ranges = fill_ranges(sizes, F.lit(limit), F.lit(overlap))
    pieces = F.transform(ranges, lambda r: F.array_join(F.slice(parts, r["first"] + 1, r["last"] - r["first"] + 1), " "))
    return F.filter(pieces, lambda p: P.strip(p) != "")


def _grouped(rows: DataFrame, keys: Sequence[str], order: str, size: str, brk: str, limit: int, name: str) -> DataFrame:
    """Adds the greedy group number `name` of every row of a document.

    The rows travel in the document's list and come out of it numbered, so what they are made from is worked out once.
    """
    others = [c for c in rows.columns if c not in (*keys, order)]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("_rows"))
    groups = fill_groups(F.transform("_rows", lambda p: p[size]), F.transform("_rows", lambda p: p[brk]), F.lit(limit))
    out = packed.select(*keys, "_rows", groups.alias("_groups")).select(*keys, F.explode(F.arrays_zip("_rows", "_groups")).alias("_z"))
    return out.select(*keys, *[F.col(f"_z._rows.{c}").alias(c) for c in rows.columns if c not in keys], F.col("_z._groups").alias(name))


def parent_groups(blocks: DataFrame, keys: Sequence[str], limit: int = V.PARENT_TOKENS) -> DataFrame:
    """Adds `parent_no`: contiguous blocks of one chapter within the parent budget."""
    sized = blocks.withColumn("tokens", X.token_estimate(F.col("body")))
    return _grouped(sized, keys, "block_no", "tokens", "chapter_num", limit, "parent_no")


def child_chunks(
    grouped: DataFrame, keys: Sequence[str], limit: int = V.CHILD_TOKENS, overlap: int = V.CHILD_OVERLAP
) -> DataFrame:
    """Children of each parent: (keys, ordinal, parent_no, text, token_count, kind, chapter_num, page).

    Only prose above the budget is split; provenance is that of a child's first block.
    """
    whole = (F.col("kind") != "prose") | (F.col("tokens") <= limit)
    long = split_prose(F.when(~whole, F.col("body")), limit, overlap)
    pieces = grouped.select(
        *keys, "parent_no", "block_no", "kind", "chapter_num", "page",
        F.posexplode(F.when(whole, F.array("body")).otherwise(long)).alias("piece", "text"),
    )
    order = Window.partitionBy(*keys).orderBy("block_no", "piece")
    pieces = pieces.withColumns(
        {"piece_no": F.row_number().over(order) - 1, "size": X.token_estimate(F.col("text"))}
    )
    packed = _grouped(pieces, keys, "piece_no", "size", "parent_no", limit, "ordinal")
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "text")))
    out = packed.groupBy(*keys, "ordinal", "parent_no").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"),
        *[F.min_by(c, "piece_no").alias(c) for c in ("kind", "chapter_num", "page")],
    )
    return out.withColumn("token_count", X.token_estimate(F.col("text")))


def parent_texts(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("block_no", "body")))
    return grouped.groupBy(*keys, "parent_no").agg(
        F.array_join(F.transform(rows, lambda r: r["body"]), "\n\n").alias("text")
    )
