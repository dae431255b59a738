"""Boxes, baselines and word positions of recognised lines, as expressions over arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.operators.nested import usable_points

#: Pitch of lines in pixels where a page tells none, and parts of it above and below a baseline.
PITCH, ABOVE, BELOW = 72.0, 0.5, 0.2


def point_list(points: Column) -> Column:
    """array<struct<x,y>> of a points string; broken tokens are left out."""
    return F.transform(usable_points(points), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))


def bbox(points: Column) -> Column:
    """struct<x0,y0,x1,y1> around a list of points, null for an empty one."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def baseline_text(points: Column) -> Column:
    """``x,y x,y`` with whole numbers."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.bround(p["x"]).cast("long").cast("string"), F.lit(","), F.bround(p["y"]).cast("long").cast("string"))), " ")


def median_y(points: Column) -> Column:
    """Median of the y values, null for an empty list."""
    ys = F.array_sort(F.transform(points, lambda p: p["y"]))
    n = F.size(ys)
    low = F.get(ys, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ys, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def y_at(points: Column, x: Column) -> Column:
    """Height of a polyline (points in the order of x) at x, straight between points, flat beyond the ends."""
    last = F.element_at(points, -1)
    first = F.get(points, F.lit(0))
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    hit = F.get(F.filter(pairs, lambda s: (s["a"]["x"] <= x) & (x <= s["b"]["x"]) & (s["a"]["x"] < s["b"]["x"])), F.lit(0))
    between = hit["a"]["y"] + (hit["b"]["y"] - hit["a"]["y"]) * (x - hit["a"]["x"]) / (hit["b"]["x"] - hit["a"]["x"])
    return F.when(F.size(points) > 0, F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(F.coalesce(between, last["y"])))


def angle(points: Column) -> Column:
    """Degrees between the first and the last point of a baseline; 0 for fewer than two points."""
    a, b = F.get(points, F.lit(0)), F.element_at(points, -1)
    return F.when(F.size(points) > 1, F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))).otherwise(F.lit(0.0))


def neighbours(lines: DataFrame, keys: list[str], y: str, order: str) -> DataFrame:
    """Lines with ``prev_y`` and ``next_y``, the baselines above and below in their region."""
    w = Window.partitionBy(*keys).orderBy(y, order)
    return lines.withColumn("prev_y", F.lag(y).over(w)).withColumn("next_y", F.lead(y).over(w))


def pitch(lines: DataFrame, page: list[str], region: list[str], y: str, order: str, default: float = PITCH) -> DataFrame:
    """page, pitch: median distance of successive baselines, pooled over the page's regions."""
    w = Window.partitionBy(*page, *region).orderBy(y, order)
    gaps = lines.withColumn("_vf_gap", F.col(y) - F.lag(y).over(w))
    return gaps.groupBy(*page).agg(F.coalesce(F.median(F.when(F.col("_vf_gap") > 0, F.col("_vf_gap"))), F.lit(default)).alias("pitch"))


def line_box(box: Column, base: Column, page_pitch: Column, prev_y: Column, next_y: Column) -> Column:
    """struct<x0,y0,x1,y1> of a line around its baseline, within its polygon's box and the middle to its neighbours.

    Where nothing is left between these (crossing baselines), the reach around the
    baseline alone; without a baseline, the polygon's box. Null without a polygon.
    """
    high, deep = base - ABOVE * page_pitch, base + BELOW * page_pitch
    top = F.greatest(box["y0"], high, F.coalesce((base + prev_y) / 2, box["y0"]))
    low = F.least(box["y1"], deep, F.coalesce((base + next_y) / 2, box["y1"]))
    made = lambda t, b: F.struct(F.bround(box["x0"]).alias("x0"), F.bround(t).alias("y0"), F.bround(box["x1"]).alias("x1"), F.bround(b).alias("y1"))
    return F.when(box.isNull(), None).when(base.isNull(), made(box["y0"], box["y1"])).when(low < top, made(high, deep)).otherwise(made(top, low))


def word_boxes(tokens: DataFrame, keys: list[str], order: str, x0: str, width: str, length: str) -> DataFrame:
    """Tokens with ``x`` and ``w``: the line's width shared by length over all runs given (words, and spaces if they are there), each share rounded half to even."""
    line = Window.partitionBy(*keys)
    share = F.bround(F.col(width) * F.col(length) / F.sum(length).over(line))
    before = line.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("w", share).withColumn("x", F.col(x0) + F.coalesce(F.sum("w").over(before), F.lit(0.0)))


def entity_words(entities: DataFrame, lines: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity id, line id, words: the tokens of each line that an entity's span touches, in order.

    Two range joins: spans with lines, then with the tokens of those lines.
    """
    from vellumflow.operators.spans import overlapping

    on_lines = overlapping(entities, lines, keys, "id", "id").select(*keys, "id", "start", "end", F.col("r_id").alias("line_id"))
    hit = overlapping(on_lines, tokens, [*keys, "line_id"], "id", "id")
    return hit.groupBy(*keys, "id", "line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_start", "r_id"))), lambda x: x["r_id"]).alias("words"))
