"""Precision, recall and F1 of every step, from classified rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.ids import CATEGORIES, kb_id
from vellumflow.operators.spans import first_partner, matched


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", empty: float = 0.0) -> DataFrame:
    """Add p, r and f1. empty: their value where there is neither gold nor prediction."""
    none = F.col(tp) + F.col(fp) + F.col(fn) == 0
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    df = df.withColumn("p", F.when(none, F.lit(empty)).otherwise(p)).withColumn("r", F.when(none, F.lit(empty)).otherwise(r))
    return df.withColumn("f1", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def relaxed(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, tp, fp, fn, p, r, f1 of overlap matches. tp counts gold spans, fp predictions without a match.

    keys: what has to be equal besides the overlap (the page, the label); leaving
    the page out pools all pages, as a compatible but looser scope.
    """
    g, p = matched(gold, pred, keys)
    gold_side = g.groupBy(*by).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    pred_side = p.groupBy(*by).agg(F.count_if(~F.col("hit")).alias("fp"))
    counts = gold_side.join(pred_side, by, "full") if by else gold_side.crossJoin(pred_side)  # one row each
    return prf(counts.na.fill(0, ["tp", "fp", "fn"]), empty=1.0)


def strict(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """As ``relaxed`` for spans that are equal in keys, start and end."""
    exact = [*keys, "start", "end"]
    g, p = gold.select(*dict.fromkeys([*exact, *by])).distinct(), pred.select(*dict.fromkeys([*exact, *by])).distinct()
    side = g.withColumn("_vf_g", F.lit(1)).join(p.withColumn("_vf_p", F.lit(1)), list(dict.fromkeys([*exact, *by])), "full")
    counts = side.groupBy(*by).agg(
        F.count_if(F.col("_vf_g").isNotNull() & F.col("_vf_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_vf_g").isNull()).alias("fp"),
        F.count_if(F.col("_vf_p").isNull()).alias("fn"),
    )
    return prf(counts, empty=1.0)


def link_outcomes(pairs: DataFrame, kbs: tuple[str, ...] = ("wd", "gn")) -> DataFrame:
    """Outcome columns of linking from gold_<kb> and pred_<kb>.

    For each knowledge base tp_<kb>, fp_<kb>, fn_<kb>: a wrong id is both a false
    negative and a false positive, a missing one a false negative, one where gold
    has none a false positive. ``_combined``: right in any base is a true positive,
    gold without a right one only a false negative, NIL with an id a false positive.
    ``_nil``: NIL said rightly, wrongly, or missed, over all bases; ``_nil_<kb>`` in
    one. An ``ERROR:`` text counts as an id.
    """
    g = {k: kb_id(F.col(f"gold_{k}")) for k in kbs}
    p = {k: kb_id(F.col(f"pred_{k}")) for k in kbs}
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {}
    for k in kbs:
        right = g[k].isNotNull() & p[k].isNotNull() & (g[k] == p[k])
        out[f"tp_{k}"] = yes(right)
        out[f"fn_{k}"] = yes(g[k].isNotNull() & (p[k].isNull() | (g[k] != p[k])))
        out[f"fp_{k}"] = yes(p[k].isNotNull() & (g[k].isNull() | (g[k] != p[k])))
        out[f"tp_nil_{k}"] = yes(g[k].isNull() & p[k].isNull())
        out[f"fp_nil_{k}"] = yes(g[k].isNotNull() & p[k].isNull())
        out[f"fn_nil_{k}"] = yes(g[k].isNull() & p[k].isNotNull())
    any_right = F.greatest(*[out[f"tp_{k}"] for k in kbs]) == 1
    gold_any = F.coalesce(*[g[k] for k in kbs]).isNotNull()
    pred_any = F.coalesce(*[p[k] for k in kbs]).isNotNull()
    out |= {
        "tp_combined": yes(any_right), "fn_combined": yes(gold_any & ~any_right), "fp_combined": yes(~gold_any & pred_any),
        "tp_nil": yes(~gold_any & ~pred_any), "fp_nil": yes(gold_any & ~pred_any), "fn_nil": yes(~gold_any & pred_any),
    }
    return pairs.withColumns(out)


def link_labels(pairs: DataFrame, kbs: tuple[str, ...] = ("wd", "gn")) -> DataFrame:
    """type_<kb>, type_combined, type_nil of each pair, as the detail table names them (TP, FP, FN, TN)."""
    df = link_outcomes(pairs, kbs)
    label = lambda tp, fp, fn: F.when(F.col(tp) == 1, "TP").when(F.col(fp) == 1, "FP").when(F.col(fn) == 1, "FN").otherwise("TN")
    new = {f"type_{k}": label(f"tp_{k}", f"fp_{k}", f"fn_{k}") for k in kbs}
    gold_any = F.coalesce(*[kb_id(F.col(f"gold_{k}")) for k in kbs]).isNotNull()
    pred_any = F.coalesce(*[kb_id(F.col(f"pred_{k}")) for k in kbs]).isNotNull()
    new["type_combined"] = F.when(F.col("tp_combined") == 1, "TP").when(pred_any, "FP").when(gold_any, "FN").otherwise("TN")
    new["type_nil"] = label("tp_nil", "fp_nil", "fn_nil")
    return df.withColumns(new).select(*pairs.columns, *new)


def link_scores(pairs: DataFrame, by: list[str], parts: tuple[str, ...] = ("wd", "gn", "combined", "nil")) -> DataFrame:
    """by, part, tp, fp, fn, p, r, f1 of linking, one row for each part."""
    df = link_outcomes(pairs)
    sums = df.groupBy(*by).agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in parts for x in ("tp", "fp", "fn")])
    rows = F.array(*[F.struct(F.lit(k).alias("part"), *[F.coalesce(F.col(f"{x}_{k}"), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]) for k in parts])
    return prf(sums.select(*by, F.inline(rows)))


def link_pairs(gold: DataFrame, pred: DataFrame, keys: list[str], kbs: tuple[str, ...] = ("wd", "gn")) -> DataFrame:
    """keys, kb, id, r_id, gold_<kb>, pred_<kb>: every gold and predicted mention, matched or alone.

    gold, pred: keys (page and label), id, start, end and a column for each knowledge
    base. A gold span goes with its first overlapping prediction, which may serve
    several; kb is ``match``, ``unmatched_gold``, or ``unmatched_pred`` for one that
    is no gold span's first. Pages that only one side has count like any other.
    """
    picks = first_partner(gold, pred, keys, [*kbs])
    side = F.when(F.col("r_id").isNull(), "unmatched_gold").otherwise("match")
    own = picks.select(*keys, side.alias("kb"), "id", "r_id", *[F.col(k).alias(f"gold_{k}") for k in kbs], *[F.col(f"r_{k}").alias(f"pred_{k}") for k in kbs])
    taken = picks.where("r_id is not null").select(F.col("r_id").alias("_vf_r")).distinct()
    alone = pred.join(taken, F.col("id") == F.col("_vf_r"), "left_anti")
    kinds = {k: gold.schema[k].dataType for k in kbs}
    other = alone.select(*keys, F.lit("unmatched_pred").alias("kb"), F.lit(None).cast(gold.schema["id"].dataType).alias("id"), F.col("id").alias("r_id"), *[F.lit(None).cast(kinds[k]).alias(f"gold_{k}") for k in kbs], *[F.col(k).alias(f"pred_{k}") for k in kbs])
    return own.unionByName(other)


def full_link_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, level, part, tp, fp, fn, p, r, f1 of ``link_pairs`` at two levels.

    ``el``: matched pairs only, with the NIL parts. ``full``: unmatched gold with an
    id is a false negative, an unmatched prediction with one a false positive.
    """
    matched_ = link_scores(pairs.where("kb = 'match'"), by, ("wd", "gn", "combined", "nil", "nil_wd", "nil_gn")).select(*by, F.lit("el").alias("level"), "part", "tp", "fp", "fn", "p", "r", "f1")
    whole = link_scores(pairs, by, ("wd", "gn", "combined")).select(*by, F.lit("full").alias("level"), "part", "tp", "fp", "fn", "p", "r", "f1")
    return matched_.unionByName(whole)


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred", classes: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """gold and one column for each class: counts, 0 where there are none; values that are no class are ignored."""
    known = pairs.where(F.col(gold).isin(*classes) & F.col(pred).isin(*classes))
    dense = pairs.sparkSession.createDataFrame([(c,) for c in classes], "gold string")
    counts = known.groupBy(F.col(gold).alias("_vf_g")).agg(*[F.count_if(F.col(pred) == c).alias(c) for c in classes])
    return dense.join(counts, F.col("gold") == F.col("_vf_g"), "left").select("gold", *[F.coalesce(c, F.lit(0)).alias(c) for c in classes])


def fine_grained(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred", digits: int | None = None) -> DataFrame:
    """by, class, tp, fp, fn, p, r, f1 of each class; digits: round p and r (half to even) before anything else uses them."""
    sides = F.array(F.struct(F.col(gold).alias("class")), F.struct(F.col(pred).alias("class")))
    both = pairs.select(*by, F.col(gold).alias("_vf_g"), F.col(pred).alias("_vf_p"), F.inline(F.array_distinct(sides))).where("class is not null")
    hit_g, hit_p = F.col("_vf_g").eqNullSafe(F.col("class")), F.col("_vf_p").eqNullSafe(F.col("class"))
    counts = both.groupBy(*by, "class").agg(F.count_if(hit_g & hit_p).alias("tp"), F.count_if(~hit_g & hit_p).alias("fp"), F.count_if(hit_g & ~hit_p).alias("fn"))
    out = prf(counts)
    return out if digits is None else out.withColumns({x: F.bround(x, digits) for x in ("p", "r", "f1")})


def macro_micro(per_class: DataFrame, by: list[str]) -> DataFrame:
    """by, macro_p, macro_r, macro_f1 (the harmonic mean of macro p and r, not the mean of F1), micro_f1 (accuracy)."""
    sums = per_class.groupBy(*by).agg(F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.sum("tp").alias("_tp"), F.sum(F.col("tp") + F.col("fn")).alias("_all"))
    return sums.select(*by, "macro_p", "macro_r", ratio(2 * F.col("macro_p") * F.col("macro_r"), F.col("macro_p") + F.col("macro_r")).alias("macro_f1"), ratio(F.col("_tp"), F.col("_all")).alias("micro_f1"))


def binary(pairs: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, tp, fp, fn, tn, p, r, f1, accuracy of two boolean columns; null counts as false."""
    g, p = F.coalesce(F.col(gold), F.lit(False)), F.coalesce(F.col(pred), F.lit(False))
    counts = pairs.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    return prf(counts).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def binary_by_place(mentions: DataFrame, by: list[str], place: str = "place") -> DataFrame:
    """``binary`` over places: a place is visited if any of its mentions is."""
    places = mentions.groupBy(*by, place).agg(F.bool_or(F.coalesce("gold", F.lit(False))).alias("gold"), F.bool_or(F.coalesce("pred", F.lit(False))).alias("pred"))
    return binary(places, by)
