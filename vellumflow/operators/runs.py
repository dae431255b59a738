"""Reports over the log of runs: latest runs, pivots, deltas, consensus, coverage of the grid of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.operators.spans import first_by


def latest_values(log: DataFrame, keys: list[str], time: str, columns: list[str], tie: str) -> DataFrame:
    """keys and, of each column on its own, the last non-null value by (time, tie)."""
    at = F.struct(time, tie)
    return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def keep(log: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One whole row of each key: the first or the last by a unique order column."""
    return first_by(log, keys, [F.desc(order) if last else F.asc(order)])


def latest_run(log: DataFrame, keys: list[str], time: str) -> DataFrame:
    """All rows of each key's latest time. The times are aggregated first, so no key's rows meet in one task; null times are never latest."""
    latest = log.groupBy(*[F.col(k).alias(f"_vf_{k}") for k in keys]).agg(F.max(time).alias("_vf_m"))
    on = F.col(time) == F.col("_vf_m")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_vf_{k}"))
    return log.join(latest, on).select(*log.columns)


def pivoted(log: DataFrame, rows: list[str], column: str, values: list, aggregate: Column, mean: str | None = None) -> DataFrame:
    """rows and one column for each value; mean: also the mean of those that aren't null.

    The values are given, so the pivot needs no pass of its own and has the same
    columns on any data.
    """
    out = log.groupBy(*rows).pivot(column, values).agg(aggregate)
    if mean:
        held = F.filter(F.array(*[F.col(f"`{v}`").cast("double") for v in values]), lambda x: x.isNotNull())
        total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn(mean, F.when(F.size(held) > 0, total / F.size(held)))
    return out


def best(log: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of the highest score of each key; of equals the first by tie; null and NaN scores never win."""
    return first_by(log.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))), keys, [F.desc(score), F.asc(tie)])


def paired(log: DataFrame, keys: list[str], column: str, a, b, score: str) -> DataFrame:
    """keys, a, b, delta, winner of configurations that have both values of ``column``; scores are averaged within one."""
    both = log.where(F.col(column).isin(a, b)).groupBy(*keys).agg(F.avg(F.when(F.col(column) == a, F.col(score))).alias("a"), F.avg(F.when(F.col(column) == b, F.col(score))).alias("b"))
    delta = F.col("a") - F.col("b")
    return both.where("a is not null and b is not null").withColumn("delta", delta).withColumn("winner", F.when(delta > 0, str(a)).when(delta < 0, str(b)).otherwise("tie"))


def tallies(deltas: DataFrame, by: list[str]) -> DataFrame:
    """by, n, above, below, ties, mean_delta, std_delta (of a sample)."""
    return deltas.groupBy(*by).agg(
        F.count("delta").alias("n"), F.count_if(F.col("delta") > 0).alias("above"), F.count_if(F.col("delta") < 0).alias("below"),
        F.count_if(F.col("delta") == 0).alias("ties"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"),
    )


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add spread (largest minus smallest) and best (the first column that has the largest); rows with a null have null."""
    values = F.array(*columns)
    whole = ~F.exists(values, lambda x: x.isNull())
    at = F.array_position(values, F.array_max(values)).cast("int")
    return df.withColumn("spread", F.when(whole, F.greatest(*columns) - F.least(*columns))).withColumn("best", F.when(whole, F.element_at(F.array(*map(F.lit, columns)), at)))


def value_counts(df: DataFrame, column: str, percent: bool = False) -> DataFrame:
    """column, n; nulls are left out. percent: also the share of all with one decimal."""
    held = df.where(F.col(column).isNotNull())
    counts = held.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not percent:
        return counts
    total = held.agg(F.count(F.lit(1)).alias("_vf_total"))  # one row
    return counts.crossJoin(total).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("_vf_total"), 1)).drop("_vf_total")


def consensus(errors: DataFrame, keys: list[str], model: str, models_in_all: int) -> DataFrame:
    """keys, n_models, n_runs, models (sorted, joined), miss_rate: which models share an error. Null keys are keys."""
    return errors.groupBy(*keys).agg(
        F.count_distinct(model).alias("n_models"), F.count(model).alias("n_runs"), F.array_join(F.array_sort(F.collect_set(model)), ", ").alias("models")
    ).withColumn("miss_rate", F.col("n_models") / F.lit(float(models_in_all)))


def share_above(rates: DataFrame, by: str, rate: str, limit: float = 0.5) -> DataFrame:
    """by, n, n_above, share of rows above a limit; keys without any are left out, so are null keys."""
    counts = rates.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(rate) > limit).alias("n_above"))
    return counts.where("n_above > 0").withColumn("share", F.col("n_above") / F.col("n"))


def duration_means(log: DataFrame, by: str, duration: str, pages_done: int = 10, pages: int = 217) -> DataFrame:
    """by, mean_s, hours: what the pages of a whole work would take at the mean of a run."""
    return log.groupBy(by).agg(F.avg(duration).alias("mean_s")).withColumn("hours", F.col("mean_s") / 60 / pages_done / 60 * pages)


def completion(grid: DataFrame, done: DataFrame, keys: list[str], row: str, cell: str) -> DataFrame:
    """row, n_done, n_cells, missing: of a grid of configurations what is there and what isn't (sorted, joined)."""
    have = done.select(*[F.col(k).alias(f"_vf_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_vf_{k}")) for k in keys]
    joined = grid.join(have, on, "left")
    there = F.col(f"_vf_{keys[0]}").isNotNull()
    return joined.groupBy(row).agg(
        F.count_if(there).alias("n_done"), F.count(F.lit(1)).alias("n_cells"), F.array_join(F.array_sort(F.collect_set(F.when(~there, F.col(cell).cast("string")))), ", ").alias("missing")
    )


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Configurations of the grid that have no run yet: what a resumed batch has to do."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def efficiency(log: DataFrame, score: str, seconds: str) -> DataFrame:
    """Add per_minute: score by minutes of running; null where nothing was measured."""
    return log.withColumn("per_minute", F.when(F.col(seconds) > 0, F.col(score) / (F.col(seconds) / 60)))


def linked_counts(mentions: DataFrame, by: list[str], wd: str = "wd", gn: str = "gn") -> DataFrame:
    """by, total, errors, linked_wd, linked_gn, linked_both, linked_neither; an ``ERROR:`` text is no link."""
    from vellumflow.functions.ids import is_error, kb_id

    w, g = F.col(wd), F.col(gn)
    has_w, has_g = kb_id(w).isNotNull() & ~is_error(w), kb_id(g).isNotNull() & ~is_error(g)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return mentions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_error(w) | is_error(g)).alias("errors"), F.count_if(yes(has_w)).alias("linked_wd"), F.count_if(yes(has_g)).alias("linked_gn"),
        F.count_if(yes(has_w & has_g)).alias("linked_both"), F.count_if(~yes(has_w) & ~yes(has_g)).alias("linked_neither"),
    )


def mislabelled(fp: DataFrame, fn: DataFrame, keys: list[str]) -> DataFrame:
    """False positives that overlap a false negative of another label: the pairs of confused labels. Both have id, label, start, end."""
    from vellumflow.operators.spans import overlapping

    return overlapping(fp, fn, keys, "id", "id").where("label <> r_label")


def consistency(pairs: DataFrame, text: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """text, n, n_correct, accuracy, gold and predicted classes (sorted), varied: whether the predictions differ."""
    out = pairs.groupBy(text).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("n_correct"),
        F.array_join(F.array_sort(F.collect_set(gold)), ", ").alias("gold_classes"), F.array_join(F.array_sort(F.collect_set(pred)), ", ").alias("pred_classes"), F.count_distinct(pred).alias("_vf_n"),
    )
    return out.withColumn("accuracy", F.col("n_correct") / F.col("n")).withColumn("varied", F.col("_vf_n") > 1).drop("_vf_n")


def sanity(scores: DataFrame, gold_count: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp_fn, gold_count, unmatched: true positives and false negatives against the number of gold rows."""
    return scores.select(*keys, (F.col("tp") + F.col("fn")).alias("tp_fn")).join(gold_count, keys).withColumn("unmatched", F.col("gold_count") - F.col("tp_fn"))


def best_existing(candidates: DataFrame, existing: DataFrame, label: str, rank: str, path: str) -> DataFrame:
    """Of each label the best-ranked run whose file exists."""
    there = candidates.join(existing.select(path).distinct(), path, "left_semi")
    return first_by(there, [label], [F.asc(rank), F.asc(path)])


def matching_sidecar(files: DataFrame, key: str, priority: str, path: str) -> DataFrame:
    """Of each key the file of the lowest priority number (exact name before pattern before parsed name)."""
    return first_by(files, [key], [F.asc(priority), F.asc(path)])


#: Thinking modes whose runs a legacy name marks.
THINK_MODES = ("low", "medium", "high")


def salvaged(files: DataFrame, wrong: str, right: str, settings: dict[str, float], name: str = "name", info: str = "info") -> DataFrame:
    """Files of thinking runs under their right name and with corrected settings, from files whose name says a wrong temperature.

    A run is a thinking one if its name holds ``_think<mode>_`` or ends so. The name's
    ``_t<wrong>_`` becomes ``_t<right>_``; in the info, a JSON object, the settings
    given stand in place of what was there. Other files and unreadable infos stay.
    """
    thinking = F.col(name).rlike(f"_think({'|'.join(THINK_MODES)})(_|$)")
    renamed = F.replace(F.col(name), F.lit(f"_t{wrong}_"), F.lit(f"_t{right}_"))
    held = F.from_json(info, "map<string,string>")
    fixed = F.create_map(*[F.lit(x) for k, v in settings.items() for x in (k, str(v))])
    merged = F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*settings)), fixed)
    return files.withColumns({name: F.when(thinking, renamed).otherwise(F.col(name)), "settings": F.when(held.isNotNull(), F.when(thinking, merged).otherwise(held))})


def probe_grid(models: DataFrame, modes: tuple[str | None, ...], prompt: str, model: str = "model") -> DataFrame:
    """model, think, prompt: every model in every thinking mode, to be asked once each."""
    each = F.explode(F.array(*[F.lit(m).cast("string") for m in modes]))
    return models.select(F.col(model).alias("model")).distinct().select("model", each.alias("think")).withColumn("prompt", F.lit(prompt))


def correction_summary(pages: DataFrame) -> DataFrame:
    """One row: lines in all, corrected and unmatched, shares, means of confidence and agreement over the pages that have one, and pages skipped.

    pages: status, total_lines, corrected_lines, unmatched_lines, confidence,
    fuzzy_accuracy, gt_chars_total, gt_chars_mapped. Shares are null without lines or
    characters.
    """
    out = pages.agg(
        F.sum("total_lines").alias("total"), F.sum("corrected_lines").alias("corrected"), F.sum("unmatched_lines").alias("unmatched"), F.avg("confidence").alias("confidence"), F.avg("fuzzy_accuracy").alias("fuzzy"),
        F.sum("gt_chars_total").alias("chars"), F.sum("gt_chars_mapped").alias("mapped"), F.count_if(F.col("status") == "no_mapping").alias("no_mapping"), F.count_if(F.col("status") == "no_gt").alias("no_gt"),
    )
    return out.withColumns({"corrected_pct": F.try_divide(F.col("corrected") * 100, F.col("total")), "coverage_pct": F.try_divide(F.col("mapped") * 100, F.col("chars"))})
