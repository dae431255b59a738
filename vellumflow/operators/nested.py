"""Deeply nested page records to flat tables that keep the keys of their parents.

Nested ``transform`` calls attach the ancestors' keys and indices, ``flatten``
joins the arrays of a record, one ``inline`` for each target table emits its rows.
All is one projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A usable token of a points string: two decimal numbers joined by one comma.
POINT = r"^[+-]?\d+(\.\d+)?,[+-]?\d+(\.\d+)?$"


def index_of(custom: Column) -> Column:
    """n of ``readingOrder {index:n;}``, null where there is none."""
    return F.regexp_extract(custom, r"readingOrder\s*\{[^}]*?index\s*:\s*(\d+)", 1).try_cast("int")


def _all(array: Column, what) -> Column:
    """transform over an array that may be null, without null elements; ``what`` gets element and index."""
    held = F.filter(F.coalesce(array, F.array()), lambda x: x.isNotNull())
    return F.transform(held, what)


def _regions() -> Column:
    """Regions and sub-regions of a record, each with its parent's id ('' for a region), its index and its lines."""

    def leaf(region: Column, parent: Column, at: Column, level: Column) -> Column:
        return F.struct(
            F.coalesce(parent, F.lit("")).alias("parent_region_id"),
            region["region_id"].alias("region_id"),
            at.alias("region_idx"),
            level.alias("is_sub"),
            region["custom"].alias("custom"),
            region["coords"]["points"].alias("points"),
            region["text_lines"].alias("text_lines"),
        )

    def one(region: Column, i: Column) -> Column:
        own = F.array(leaf(region, F.lit(""), i, F.lit(False)))
        subs = F.filter(F.coalesce(region["sub_regions"], F.array()), lambda s: s.isNotNull())
        return F.concat(own, F.transform(subs, lambda s, j: leaf(s, region["region_id"], j, F.lit(True))))

    held = F.filter(F.coalesce(F.col("regions"), F.array()), lambda x: x.isNotNull())
    return F.flatten(F.transform(held, one))


def regions(scans: DataFrame) -> DataFrame:
    """rec_id, parent_region_id, region_id, region_idx, is_sub, reading_idx, custom, points, n_lines.

    reading_idx is the index in ``custom``, else the place in ``reading_order``,
    else null. Records without regions give no row; null structs are skipped.
    """
    ordered = F.filter(F.coalesce(F.col("reading_order"), F.array()), lambda r: r.isNotNull())

    def flat(r: Column) -> Column:
        listed = F.get(F.filter(ordered, lambda o: o["region_ref"] == r["region_id"]), F.lit(0))["idx"]
        return F.struct(
            r["parent_region_id"].alias("parent_region_id"),
            r["region_id"].alias("region_id"),
            r["region_idx"].alias("region_idx"),
            r["is_sub"].alias("is_sub"),
            F.coalesce(index_of(r["custom"]), listed).alias("reading_idx"),
            r["custom"].alias("custom"),
            r["points"].alias("points"),
            F.size(F.filter(F.coalesce(r["text_lines"], F.array()), lambda x: x.isNotNull())).alias("n_lines"),
        )

    return scans.select("rec_id", F.inline(F.transform(_regions(), flat)))


def lines(scans: DataFrame) -> DataFrame:
    """rec_id, parent_region_id, region_id, line_id, is_sub, region_reading_idx, region_idx, line_idx, reading_idx, coords, baseline, conf, text.

    text is the first text_equiv that has any (unicode_text, else plain_text), null
    if none has. Null lines are skipped, empty and null arrays give no row.
    """
    ordered = F.filter(F.coalesce(F.col("reading_order"), F.array()), lambda r: r.isNotNull())

    def flat(r: Column) -> Column:
        listed = F.get(F.filter(ordered, lambda o: o["region_ref"] == r["region_id"]), F.lit(0))["idx"]
        place = F.coalesce(index_of(r["custom"]), listed)

        def line(x: Column, i: Column) -> Column:
            texts = F.filter(
                F.coalesce(x["text_equiv"], F.array()),
                lambda t: F.coalesce(t["unicode_text"], t["plain_text"]).isNotNull(),
            )
            first = F.get(texts, F.lit(0))
            return F.struct(
                r["parent_region_id"].alias("parent_region_id"),
                r["region_id"].alias("region_id"),
                x["line_id"].alias("line_id"),
                r["is_sub"].alias("is_sub"),
                place.alias("region_reading_idx"),
                r["region_idx"].alias("region_idx"),
                i.alias("line_idx"),
                index_of(x["custom"]).alias("reading_idx"),
                x["coords"]["points"].alias("coords"),
                x["baseline"]["points"].alias("baseline"),
                first["conf"].alias("conf"),
                F.coalesce(first["unicode_text"], first["plain_text"]).alias("text"),
            )

        return _all(r["text_lines"], line)

    return scans.select("rec_id", F.inline(F.flatten(F.transform(_regions(), flat))))


def usable_points(points: Column) -> Column:
    """Usable tokens of a points string, in order; empty for null."""
    tokens = F.split(F.coalesce(points, F.lit("")), r"[\s  -  　]+")
    return F.filter(tokens, lambda t: t.rlike(POINT))


def points(scans: DataFrame) -> DataFrame:
    """rec_id, parent_region_id, region_id, line_id, child, point_no, x, y: each usable point.

    child is ``coords`` or ``baseline``; line_id is '' for a region's own coords;
    point_no counts the usable points of its string from 0. Null ids become ''.
    """

    def of(r: Column, line_id: Column, child: str, text: Column) -> Column:
        return F.transform(
            usable_points(text),
            lambda p, i: F.struct(
                r["parent_region_id"].alias("parent_region_id"),
                F.coalesce(r["region_id"], F.lit("")).alias("region_id"),
                F.coalesce(line_id, F.lit("")).alias("line_id"),
                F.lit(child).alias("child"),
                i.alias("point_no"),
                F.split(p, ",")[0].try_cast("double").alias("x"),
                F.split(p, ",")[1].try_cast("double").alias("y"),
            ),
        )

    def flat(r: Column) -> Column:
        own = of(r, F.lit(""), "coords", r["points"])
        inner = _all(
            r["text_lines"],
            lambda x: F.concat(of(r, x["line_id"], "coords", x["coords"]["points"]), of(r, x["line_id"], "baseline", x["baseline"]["points"])),
        )
        return F.concat(own, F.flatten(inner))

    return scans.select("rec_id", F.inline(F.flatten(F.transform(_regions(), flat))))
