"""Letters to pages, and positions to pages.

A page has ``start_off``, the place of its first character in the whole text.
Bounds are half-open: a page ends where the next one starts, the last has no end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.operators.ordered import with_neighbours
from vellumflow.session import spread

_RUN = re.compile(r"[^ \t\n\x0b\f\r]+")
_RUN_OR_SPACE = re.compile(r"[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")
MARKER = r"\[\d+\]"
ANY_MARKER = r"\[[IVXLCDM\d]+\]"


def _tiles(text: Column, pattern: str) -> Column:
    """Pieces of a text that tile it, each but the first beginning with the pattern: array<struct<piece, start>>."""
    pieces = F.split(text, rf"(?={pattern})")
    return F.aggregate(
        pieces,
        F.struct(F.array().cast("array<struct<piece:string,start:bigint>>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.array(F.struct(p.alias("piece"), acc["at"].alias("start")))).alias("out"), (acc["at"] + F.length(p)).alias("at")),
        lambda acc: acc["out"],
    )


def by_markers(letters: DataFrame, letter_id: str = "letter_id", text: str = "text", pattern: str = MARKER, keep_marker: bool = True) -> DataFrame:
    """letter_id, page, start_off, text by ``[N]`` markers.

    Text before the first marker and blank pages are dropped; of a repeated marker
    the last page stands. The page's text holds its marker unless keep_marker is
    false (then it is also stripped).
    """
    pieces = letters.select(F.col(letter_id).alias("letter_id"), F.inline(_tiles(F.col(text), pattern))).where(F.col("piece").rlike(f"^{pattern}"))
    bare = F.regexp_replace("piece", f"^{pattern}", "")
    pages = pieces.where(F.trim(F.regexp_replace(bare, r"\s+", " ")) != "").select(
        "letter_id",
        F.regexp_extract("piece", r"^\[([^\]]+)\]", 1).alias("page"),
        F.col("start").alias("start_off"),
        (F.col("piece") if keep_marker else F.btrim(bare, F.lit(" \t\r\n"))).alias("text"),
    )
    last = Window.partitionBy("letter_id", "page").orderBy(F.desc("start_off"))
    return pages.withColumn("_vf_n", F.row_number().over(last)).where("_vf_n = 1").drop("_vf_n")


def by_rule(letters: DataFrame, letter_id: str = "letter_id", text: str = "text", rule: str = r"\n_{16,}\n") -> DataFrame:
    """letter_id, page (1..n), start_off, text by horizontal rules (or any separator).

    A byte-order mark goes, pieces are stripped, empty ones dropped; start_off sums
    the lengths of the stripped pieces before.
    """
    clean = F.regexp_replace(F.col(text), "^﻿", "")
    stripped = F.transform(F.split(clean, rule), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    held = F.filter(stripped, lambda p: p != "")
    pages = F.transform(
        held,
        lambda p, i: F.struct(
            (i + 1).alias("page"),
            F.aggregate(F.slice(held, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("start_off"),
            p.alias("text"),
        ),
    )
    return letters.select(F.col(letter_id).alias("letter_id"), F.inline(pages))


def bounds(pages: DataFrame, keys: list[str], start: str = "start_off") -> DataFrame:
    """Pages with ``end_off``: the start of the next page, null for the last."""
    return pages.withColumn("end_off", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def with_offsets(pages: DataFrame, keys: list[str], order: list[str], text: str = "text", gap: int = 0) -> DataFrame:
    """Pages with ``start_off`` as the running length of the texts before, ``gap`` characters between them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_off", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))


def assigned(spans: DataFrame, pages: DataFrame, keys: list[str], at: str = "start", how: str = "inner") -> DataFrame:
    """Each span with the page that its start lies in (``page``, ``page_start``); inner drops those before the first page.

    An equi join on the keys with a half-open range; pages of one key are few.
    """
    bounded = bounds(pages.select(*keys, F.col("page"), F.col("start_off").alias("page_start")), keys, "page_start").select(
        *[F.col(k).alias(f"_vf_{k}") for k in keys], "page", "page_start", F.col("end_off").alias("_vf_end")
    )
    on = (F.col(at) >= F.col("page_start")) & (F.col("_vf_end").isNull() | (F.col(at) < F.col("_vf_end")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_vf_{k}"))
    return spans.join(bounded, on, how).drop("_vf_end", *[f"_vf_{k}" for k in keys])


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, value: str) -> DataFrame:
    """Points with ``as_of_value``, the value of the last mark at or before them (null if none); marks with a null value don't count.

    Both are put in one order, which is split by ranges (``ordered.with_neighbours``),
    so neither a range join is needed nor all of one key in one task. Of marks at the
    same time the one with the larger value is the last.
    """
    kind = marks.schema[value].dataType
    left = points.select("*", F.lit(1).alias("_vf_side"), F.col(at).alias("_vf_at"), F.lit(None).cast(kind).alias("_vf_value"))
    right = marks.select(
        *[F.col(c).alias(c) if c in keys else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns],
        F.lit(0).alias("_vf_side"), F.col(mark_at).alias("_vf_at"), F.col(value).alias("_vf_value"),
    )
    seen = with_neighbours(left.unionByName(right), keys, ["_vf_at", "_vf_side", "_vf_value"], last_seen={"as_of_value": "_vf_value"})
    return seen.where("_vf_side = 1").drop("_vf_side", "_vf_at", "_vf_value")


def remapped(spans: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Offsets of a raw text to offsets of its stripped, joined chunks.

    chunks: keys, raw_start, raw_end, content_start, content_end (of the stripped
    part), out_start. A place in the leading space goes to the chunk's start, one in
    the trailing space to its end, one between chunks to the next chunk. Spans whose
    ends map and whose length stays positive get ``new_start`` and ``new_end``;
    others are left out. The character map is never materialised.
    """
    length = F.col("content_end") - F.col("content_start")

    def place(df: DataFrame, column: str, out: str) -> DataFrame:
        c = chunks.select(*[F.col(k).alias(f"_vf_{k}") for k in keys], "raw_start", "raw_end", "content_start", "content_end", "out_start")
        prev = F.coalesce(F.lag("raw_end").over(Window.partitionBy(*[f"_vf_{k}" for k in keys]).orderBy("raw_start")), F.lit(-1))
        c = c.withColumn("_vf_prev", prev)
        x = F.col(column)
        on = (x > F.col("_vf_prev")) & (x <= F.col("raw_end"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"_vf_{k}"))
        offset = F.when(x <= F.col("content_start"), 0).when(x >= F.col("content_end"), length).otherwise(x - F.col("content_start"))
        return df.join(c, on).withColumn(out, F.col("out_start") + offset).drop(*[f"_vf_{k}" for k in keys], "_vf_prev", "raw_start", "raw_end", "content_start", "content_end", "out_start")

    return place(place(spans, "start", "new_start"), "end", "new_end").where("new_end > new_start")


def remap_counts(spans: DataFrame, chunks: DataFrame, keys: list[str], span_id: str = "id") -> DataFrame:
    """keys, n, mapped, missed: how many spans ``remapped`` keeps and leaves out."""
    kept = remapped(spans, chunks, keys).select(F.col(span_id).alias("_vf_id"), *[F.col(k).alias(f"_vf_{k}") for k in keys]).distinct()
    on = F.col(span_id) == F.col("_vf_id")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_vf_{k}"))
    rows = spans.join(kept, on, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_vf_id").alias("mapped"))
    return rows.withColumn("missed", F.col("n") - F.col("mapped"))


def tokenized(df: DataFrame, key: str, text: str = "text", spaces: bool = False) -> DataFrame:
    """key, id (place of the token), token, start, end of the non-space runs of a text (and the runs of space), offsets in code points.

    One linear pass over each text inside its Arrow batch, whose columns are built
    whole, so neither tokens nor texts are shuffled. Null and empty texts give no row.
    """
    import numpy as np
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: list[str] = []
            rows, ids, starts = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                runs = _RUN_OR_SPACE.findall(value) if value else []
                if not runs:
                    continue
                places = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                if spaces:
                    own, at = runs, places[:-1]
                else:
                    first = 1 if _RUN.match(runs[0]) is None else 0
                    own, at = runs[first::2], places[first:-1:2]
                tokens += own
                starts.append(at)
                ids.append(np.arange(len(own), dtype=np.int32))
                rows.append(np.full(len(own), row, dtype=np.int64))
            if not tokens:
                continue
            column = pa.array(tokens, pa.string())
            start = np.concatenate(starts).astype(np.int64)
            end = start + np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            keys = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(ids)), column, pa.array(start), pa.array(end)], names=[key, "id", "token", "start", "end"])

    return spread(df.select(key, text), key).mapInArrow(cut_up, f"`{key}` {kind}, id int, token string, start long, end long")
