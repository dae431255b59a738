"""Exact look-ups between annotations, pages and runs, report heads, and filters of the log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions.text import page_sort
from vellumflow.operators.graph import VISITS, mention_places, toponyms, visited
from vellumflow.operators.spans import first_by


def with_mention(spans: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with ``mention_id`` of the mention of the same place and text, case aside; null where there is none.

    spans, mentions: keys, start, end, text; mentions also mention_id. Of several
    mentions of one place the last one by id counts.
    """
    known = mentions.groupBy(*[F.col(k).alias(f"_vf_{k}") for k in keys], F.col("start").alias("_vf_a"), F.col("end").alias("_vf_b"), F.lower("text").alias("_vf_t")).agg(F.max("mention_id").alias("mention_id"))
    on = (F.col("start") == F.col("_vf_a")) & (F.col("end") == F.col("_vf_b")) & (F.lower("text") == F.col("_vf_t"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_vf_{k}"))
    return spans.join(known, on, "left").drop("_vf_a", "_vf_b", "_vf_t", *[f"_vf_{k}" for k in keys])


def transferred(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New annotations with the values that old ones of the same keys had (text, label, start, end, say), where they have none themselves.

    Of repeated old ones the greatest value counts, column by column.
    """
    known = old.groupBy(*[F.col(k).alias(f"_vf_{k}") for k in keys]).agg(*[F.max(c).alias(f"_vf_old_{c}") for c in columns])
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_vf_{k}")
        on = same if on is None else on & same
    joined = new.join(known, on, "left")
    return joined.select(*[F.coalesce(c, f"_vf_old_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])


def with_scan(pages: DataFrame, mapping: DataFrame, page: str = "page") -> DataFrame:
    """Pages with the scan that their printed page is on, null where none is mapped. mapping: page, scan (one row a page)."""
    known = mapping.select(F.col("page").alias("_vf_p"), "scan")
    return pages.join(known, F.col(page) == F.col("_vf_p"), "left").drop("_vf_p")


def without_failures(log: DataFrame, failed: str = "count_failed_pages", **settings: object) -> DataFrame:
    """Runs without a failed page, of one configuration (column=value; None means null); a null count is no failure."""
    kept = log.where(F.coalesce(F.col(failed), F.lit(0)) == 0)
    for column, value in settings.items():
        kept = kept.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return kept


def is_run(name: Column) -> Column:
    """Whether a file's stem names a run (source and model parted by ``__``); the others are gold references."""
    return F.coalesce(F.contains(name, F.lit("__")), F.lit(False))


def shown(errors: DataFrame, text: str, start: str, end: str, kind: str | None = None, holds: str | None = None, around: int = 60, type_column: str = "type") -> DataFrame:
    """Errors of a kind whose span's text matches a pattern, case aside, with ``before``, ``said`` and ``after``."""
    at, to = F.col(start).cast("int"), F.col(end).cast("int")
    low = F.greatest(at - around, F.lit(0))
    rows = errors.withColumns({"before": F.substring(text, low + 1, at - low), "said": F.substring(text, at + 1, to - at), "after": F.substring(text, to + 1, F.lit(around))})
    rows = rows if kind is None else rows.where(F.col(type_column) == kind)
    return rows if holds is None else rows.where(F.col("said").rlike(f"(?i){holds}"))


def head(df: DataFrame, order: list[Column], n: int, key: str) -> DataFrame:
    """The first n rows in an order of mixed directions, ties by the key: a report's head."""
    return df.orderBy(*order, F.asc(key)).limit(n)


def limited(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows for each key, as an interface's limit cuts them."""
    return first_by(rows, keys, order, n)


def gold_of(files: DataFrame, golds: DataFrame, default: str) -> DataFrame:
    """Result files with ``gold``: ``<source>.csv`` if it exists, else ``<source>_el_gs.csv``, else the default.

    The source is what stands before the first ``__`` of the stem (without a closing
    ``_el``), without one what stands before ``_el``. files: stem; golds: name.
    """
    base = F.regexp_replace("stem", "_el$", "")
    source = F.when(F.contains(base, F.lit("__")), F.substring_index(base, "__", 1)).otherwise(F.substring_index(base, "_el", 1))
    known = golds.select(F.col("name").alias("_vf_n")).distinct()
    own = known.select(F.col("_vf_n").alias("_vf_a"))
    joined = files.withColumn("_vf_s", source).join(own, F.concat("_vf_s", F.lit(".csv")) == F.col("_vf_a"), "left")
    joined = joined.join(known, F.concat("_vf_s", F.lit("_el_gs.csv")) == F.col("_vf_n"), "left")
    return joined.withColumn("gold", F.coalesce("_vf_a", "_vf_n", F.lit(default))).drop("_vf_a", "_vf_n", "_vf_s")


def citation_coverage(relations: DataFrame, triples: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """category, total, linked, not_linked, note of a letter's stated relations against its triples.

    linked: the mention's place is one that an event leads to, from, or has near. note
    is ``non-compliance`` for a category that says a visit and has mentions that
    aren't linked, ``contamination`` for NO_REL with linked ones. relations:
    mention_id, category. Categories without mentions have a row of zeros.
    """
    seen = visited(triples, VISITS).select(F.col("place").alias("_vf_p"))
    linked = mention_places(triples).join(seen, F.col("place") == F.col("_vf_p"), "left_semi").select(F.col("mention").alias("_vf_m")).distinct()
    rows = relations.select("mention_id", "category").distinct().join(linked, F.col("mention_id") == F.col("_vf_m"), "left")
    counts = rows.groupBy(F.col("category").alias("_vf_c")).agg(F.count(F.lit(1)).alias("total"), F.count("_vf_m").alias("linked"))
    all_ = relations.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    out = all_.join(counts, F.col("category") == F.col("_vf_c"), "left").select("category", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "linked")])
    out = out.withColumn("not_linked", F.col("total") - F.col("linked"))
    none = F.col("category") == "NO_REL"
    return out.withColumn("note", F.when(none & (F.col("linked") > 0), "contamination").when(~none & (F.col("not_linked") > 0), "non-compliance").otherwise(""))


def grouped_violations(violations: DataFrame, n: int = 5) -> DataFrame:
    """rule, severity, n, examples: breaches by rule, with the first n subjects in order."""
    counts = violations.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    subjects = violations.select(F.col("rule").alias("_vf_r"), F.col("severity").alias("_vf_s"), "subject").distinct()
    first = first_by(subjects, ["_vf_r", "_vf_s"], ["subject"], n).groupBy("_vf_r", "_vf_s").agg(F.array_sort(F.collect_list("subject")).alias("examples"))
    return counts.join(first, (F.col("rule") == F.col("_vf_r")) & (F.col("severity") == F.col("_vf_s"))).select("rule", "severity", "n", "examples")


def unique_pairs(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n_pairs, n_a, n_b: different pairs of two columns, and different values of each."""
    return df.groupBy(*by).agg(F.count_distinct(a, b).alias("n_pairs"), F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))


def distribution(df: DataFrame, column: str, classes: tuple[str, ...]) -> DataFrame:
    """class, n, share of a column's values among the classes given; classes without rows have zeros."""
    counts = df.where(F.col(column).isin(*classes)).groupBy(F.col(column).alias("_vf_c")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    rows = all_.join(counts, F.col("class") == F.col("_vf_c"), "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a class
    return rows.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def by_first_visit(triples: DataFrame, order: DataFrame) -> DataFrame:
    """place, seq: toponyms in the order in which the chain comes to them; those of no event in the chain have a null seq.

    order: event, seq. A move comes from its P27 before it comes to its P26; another
    event is at its P7, then within its P8.
    """
    rank = F.when(F.col("p").isin("P27", "P7"), 0).when(F.col("p").isin("P26", "P8"), 1)
    steps = triples.where(F.col("p").isin("P27", "P26", "P7", "P8")).select(F.col("s").alias("event"), rank.alias("k"), F.col("o").alias("place")).join(order, "event")
    first = steps.groupBy("place").agg(F.min(F.struct("seq", "k")).alias("at"))
    places = visited(triples, (*VISITS, "P8")).select(F.col("place").alias("_vf_p")).join(toponyms(triples), F.col("_vf_p") == F.col("x"), "left_semi")
    return places.join(first, F.col("place") == F.col("_vf_p"), "left").select(F.col("_vf_p").alias("place"), F.col("at.seq").alias("seq"), F.col("at.k").alias("step"))


def sort_kinds(page: Column) -> Column:
    """The four sort keys of a page's label as one struct, for comparing readings of the same book."""
    return F.struct(*[page_sort(page, c).alias(c) for c in ("tuple", "to_xl", "to_xx", "int")])
