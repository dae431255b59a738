"""Half-open spans: overlaps, matches of gold and predicted spans, ordered filters.

Overlap joins go over the equal keys and, on long texts, over bins of the span's
extent, so no pair of a key is formed that doesn't share a bin. Folds that depend on
order (greedy filters) run over the sorted array of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin; spans are short, so most lie in one or two bins.
BIN = 256


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def jaccard(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the length of both together; 0 if they don't overlap."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return shared / (F.greatest(a1, b1) - F.least(a0, b0))


def _binned(df: DataFrame, start: str, end: str) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / BIN))
    return df.withColumn("_vf_bin", F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs of overlapping spans with equal keys: left columns, then right columns with the prefix ``r_``.

    Both sides have start and end. A pair that shares several bins is kept in the
    first of them only, so there is nothing to remove afterwards. Null keys or
    bounds match nothing.
    """
    a = _binned(left, "start", "end")
    b = _binned(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_start", "r_end").withColumnRenamed("_vf_bin", "_vf_rbin")
    on = F.col("_vf_bin") == F.col("_vf_rbin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    first = F.greatest(F.floor(F.col("start") / BIN), F.floor(F.col("r_start") / BIN)) == F.col("_vf_bin")
    return a.join(b, on & overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) & first).drop("_vf_bin", "_vf_rbin")


def _both_sides(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer form of ``overlapping``: spans of either side without a partner stand alone (once for each of their bins).

    Each side is read once; what is grouped from it afterwards reuses its exchange.
    """
    a = _binned(gold, "start", "end")
    b = _binned(pred.select(*[F.col(c).alias(f"r_{c}") for c in pred.columns]), "r_start", "r_end").withColumnRenamed("_vf_bin", "_vf_rbin")
    on = F.col("_vf_bin") == F.col("_vf_rbin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return a.join(b, on & overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")), "full")


def matched(gold: DataFrame, pred: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(gold, pred) with ``hit``: whether a span of the other side with equal keys overlaps. Both have a unique ``id``."""
    both = _both_sides(gold, pred, keys)
    g = both.where("id is not null").groupBy(*gold.columns).agg(F.bool_or(F.col("r_id").isNotNull()).alias("hit"))
    p = both.where("r_id is not null").groupBy(*[F.col(f"r_{c}").alias(c) for c in pred.columns]).agg(F.bool_or(F.col("_vf_bin").isNotNull()).alias("hit"))
    return g, p


def instances(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """type (TP, FN, FP), id, r_id: each gold with its first overlapping prediction, gold without, predictions without.

    First means by (start, end, id); a prediction may serve several gold spans.
    """
    both = _both_sides(gold, pred, keys)
    first = both.where("id is not null").groupBy("id").agg(F.min(F.when(F.col("r_id").isNotNull(), F.struct("r_start", "r_end", "r_id"))).alias("f"))
    gold_side = first.select(F.when(F.col("f").isNull(), "FN").otherwise("TP").alias("type"), "id", F.col("f.r_id").alias("r_id"))
    alone = both.where("r_id is not null").groupBy("r_id").agg(F.bool_or(F.col("_vf_bin").isNotNull()).alias("hit")).where("not hit")
    return gold_side.unionByName(alone.select(F.lit("FP").alias("type"), F.lit(None).cast(gold.schema["id"].dataType).alias("id"), "r_id"))


def first_partner(gold: DataFrame, pred: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Gold columns, r_id and r_<column>: each gold span with its first overlapping prediction by (start, end, id), nulls without one."""
    held = F.min(F.when(F.col("r_id").isNotNull(), F.struct("r_start", "r_end", "r_id", *[f"r_{c}" for c in columns])))
    both = _both_sides(gold, pred, keys).where("id is not null")
    first = both.groupBy(*gold.columns).agg(held.alias("_vf_f"))
    return first.select(*gold.columns, "_vf_f.r_id", *[F.col(f"_vf_f.r_{c}") for c in columns])


def best_jaccard(gold: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """id, r_id, jaccard: each gold with the mention of the highest Jaccard; of equals the first by r_id. Gold may share one."""
    pairs = overlapping(gold, mentions, keys, "id", "id").withColumn("jaccard", jaccard(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    best = Window.partitionBy("id").orderBy(F.desc("jaccard"), "r_id")
    return pairs.withColumn("_vf_n", F.row_number().over(best)).where("_vf_n = 1").select("id", "r_id", "jaccard")


def not_contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that don't lie inside one kept before, in the order (start, longest first): a running maximum of the ends."""
    before = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_vf_m", F.max("end").over(before)).where("_vf_m is null or end > _vf_m").drop("_vf_m")


def greedy(spans: DataFrame, keys: list[str], order: str = "input") -> DataFrame:
    """keys, kept: spans taken one after the other unless they overlap one taken before; array<struct<start,end,id>>.

    order: ``input`` (by id) or ``longest`` (longest first, then by id). The spans
    of one key (a page) are folded in one array.
    """
    rank = F.col("id") if order == "input" else F.struct((F.col("start") - F.col("end")).alias("l"), F.col("id").alias("i"))
    listed = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "start", "end", "id"))).alias("s"))
    empty = F.array().cast(f"array<struct<start:{spans.schema['start'].dataType.simpleString()},end:{spans.schema['end'].dataType.simpleString()},id:{spans.schema['id'].dataType.simpleString()}>>")
    fold = F.aggregate(
        "s",
        empty,
        lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k["start"], k["end"], x["start"], x["end"])), kept).otherwise(
            F.concat(kept, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["id"].alias("id"))))
        ),
    )
    return listed.select(*keys, fold.alias("kept"))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; give a unique last column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_vf_n", F.row_number().over(w)).where(F.col("_vf_n") <= n).drop("_vf_n")


def snapped(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Spans grown to the tokens they touch: keys, id, start, end. Spans that touch none are left out."""
    pairs = overlapping(spans, tokens, keys, "id", "id")
    return pairs.groupBy(*keys, "id").agg(F.min("r_start").alias("start"), F.max("r_end").alias("end"))
