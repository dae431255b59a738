"""Gold documents and templates: annotations on pages, snapped to tokens, and tables that annotators fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.operators.pages import assigned, with_offsets
from vellumflow.operators.spans import first_by, greedy, snapped


def documents(gold: DataFrame, pages: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, entities: array<struct<start,end,id>> of each page with gold, in the order of the annotations.

    gold: keys, id, start, end (in the whole text); pages: keys, page, start_off;
    tokens: keys, page, id, start, end (in the page). A span goes to the page it
    begins on, grows to the tokens it touches, and is left out where it touches none
    or overlaps one before it.
    """
    local = assigned(gold, pages, keys).withColumns({"start": F.col("start") - F.col("page_start"), "end": F.col("end") - F.col("page_start")})
    grown = snapped(local.select(*keys, "page", "id", "start", "end"), tokens, [*keys, "page"])
    return greedy(grown, [*keys, "page"], "input").withColumnRenamed("kept", "entities")


def template(entities: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, text, label, start_char, end_char, wikidata_qid, geonames_id: a table for annotators, one row for each (page, text case aside, label).

    entities: keys, page, id, start, end (in the page), text, label, wd, gn; pages:
    keys, page, seq, text. Offsets count over the pages' texts in their order; the
    leading space of the first page doesn't count. Ids are empty where there are none.
    """
    first = F.col("seq") == F.min("seq").over(Window.partitionBy(*keys))
    stripped = pages.withColumn("_vf_lead", F.when(first, F.length("text") - F.length(F.ltrim("text"))).otherwise(F.lit(0)))
    placed = with_offsets(stripped.withColumn("_vf_t", F.substring("text", F.col("_vf_lead") + 1, F.length("text"))), keys, ["seq"], "_vf_t")
    own = placed.select(*[F.col(k).alias(f"_vf_{k}") for k in keys], F.col("page").alias("_vf_page"), "start_off", "_vf_lead")
    on = F.col("page") == F.col("_vf_page")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_vf_{k}"))
    shift = F.col("start_off") - F.col("_vf_lead")
    rows = entities.join(own, on).withColumns({"start_char": F.col("start") + shift, "end_char": F.col("end") + shift, "_vf_low": F.lower("text")})
    kept = first_by(rows, [*keys, "page", "_vf_low", "label"], ["start", "id"])
    return kept.select(*keys, "page", "text", "label", "start_char", "end_char", F.coalesce("wd", F.lit("")).alias("wikidata_qid"), F.coalesce("gn", F.lit("")).alias("geonames_id"))
