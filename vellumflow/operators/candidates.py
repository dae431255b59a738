"""Candidates of a mention in lanes: search by its text, by a predicted profile, by full text, and in a gazetteer.

What is external is a function or a table that the caller gives: a model for the
profile, an index of labels (id, lang, label, description, rank) for the searches.
Each different (text, label) is looked up once, with the context of its first
mention, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow import external
from vellumflow.functions.text import json_in, location_terms
from vellumflow.operators.linking import gazetteer_search, merged_lanes
from vellumflow.operators.spans import first_by

#: Rows that a search by text, by profile, and by full text gives at most.
LIMIT, PROFILE_LIMIT, PAGES = 15, 15, 8
#: Languages in which a text is searched, in order.
SEARCHED = ("nl", "en", "de")
#: Characters of the context that tell one question from another.
CONTEXT = 300


def profile_prompt(text: Column, label: Column, context: Column) -> Column:
    """What a model is asked about a mention: its modern name, region and kind, as one JSON object."""
    return F.concat(
        F.lit("Which place or building does this mention of an old letter mean today?\nMention: "), text, F.lit("\nLabel: "), label, F.lit("\nContext: "), context,
        F.lit('\nAnswer with one JSON object only: {"modern_name": text, "country_or_region": text, "type_keywords": [at most three words]}'),
    )


def choice_prompt(text: Column, context: Column, listed: Column, rank: bool) -> Column:
    """What a model is asked about a numbered list of candidates: a score for each (rank), or the id of one or NIL."""
    task = "Give each number a score from 0 to 10, one line each, as `number: score`." if rank else "Answer with the id of the right candidate, or NIL if none is."
    return F.concat(F.lit("Mention: "), text, F.lit("\nContext: "), context, F.lit("\nCandidates:\n"), listed, F.lit(f"\n{task}"))


def events_prompt(letter: Column, marked: Column, examples: str = "") -> Column:
    """What a model is asked about a letter with marked mentions: its events and the relation of each place."""
    task = "List the travel events of this letter as JSON: {\"events\": [...], \"toponym_relations\": {mention: category}}. Use the mention ids.\n"
    return F.concat(F.lit(task + (f"Examples:\n{examples}\n" if examples else "")), F.lit("Letter "), letter, F.lit(":\n"), marked)


def lines_prompt(lines: Column, transcription: Column) -> Column:
    """What a model is asked about recognised lines and a transcription: the transcribed text of each line number."""
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.coalesce(x, F.lit("")))), "\n")
    return F.concat(F.lit("Give the transcribed text of each numbered line as JSON {\"1\": text, ..., \"confidence\": number}.\nLines:\n"), numbered, F.lit("\nTranscription:\n"), transcription)


def profiled(mentions: DataFrame, model: Callable[[str], str], **parameters) -> DataFrame:
    """Mentions (text, label, context) with ``profile``: struct<modern_name, country_or_region, type_keywords>, null without text or context or on any failure.

    Mentions with the same text, label and beginning of the context are one question.
    """
    rows = mentions.withColumn("_vf_c", F.left("context", F.lit(CONTEXT)))
    asking = F.when((F.trim("context") != "") & (F.trim("text") != ""), profile_prompt(F.col("text"), F.col("label"), F.col("_vf_c")))
    rows = rows.withColumn("_vf_p", asking)
    answers = external.asked(rows, model, "_vf_p", **parameters).where("not failed")
    kind = "struct<modern_name:string,country_or_region:string,type_keywords:array<string>>"
    said = answers.select(F.col("prompt").alias("_vf_q"), F.try_variant_get(F.try_parse_json(json_in(F.col("answer"))), "$", kind).alias("profile"))
    return rows.join(said, F.col("_vf_p") == F.col("_vf_q"), "left").drop("_vf_c", "_vf_p", "_vf_q")


def searched(mentions: DataFrame, index: DataFrame, languages: tuple[str, ...] = SEARCHED, limit: int = LIMIT, key: str = "mention_key") -> DataFrame:
    """key, kb, id, label, description, source, pos: entries whose label is a mention's text, case aside, language after language.

    Of each language the first ``limit`` by rank; an id that several languages give
    stands once. Null and empty texts find nothing.
    """
    texts = mentions.where(F.trim("text") != "").select(key, F.lower(F.trim("text")).alias("_vf_t"))
    known = index.where(F.col("lang").isin(*languages)).select("id", "lang", "label", "description", "rank", F.lower(F.trim("label")).alias("_vf_l"))
    hits = first_by(texts.join(known, F.col("_vf_t") == F.col("_vf_l")), [key, "lang"], ["rank", "id"], limit)
    hits = hits.withColumn("_vf_o", F.array_position(F.array(*map(F.lit, languages)), F.col("lang")))
    once = first_by(hits, [key, "id"], ["_vf_o", "rank"])
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_vf_o", "rank", "id"))
    return once.select(key, F.lit("wd").alias("kb"), "id", "label", "description", F.lit("wikidata_text").alias("source"), pos.alias("pos"))


def by_profile(profiles: DataFrame, index: DataFrame, limit: int = PROFILE_LIMIT, key: str = "mention_key") -> DataFrame:
    """As ``searched`` for the modern name of a profile, entries whose description holds every term of its region that is not too broad."""
    wanted = profiles.where(F.trim("profile.modern_name") != "").select(key, F.lower(F.trim("profile.modern_name")).alias("_vf_t"), location_terms(F.col("profile.country_or_region")).alias("_vf_terms"))
    known = index.where("lang = 'en' and description is not null").select("id", "label", "description", "rank", F.lower(F.trim("label")).alias("_vf_l"))
    hits = wanted.join(known, F.col("_vf_t") == F.col("_vf_l")).where(F.forall("_vf_terms", lambda x: F.contains(F.lower("description"), x)))
    best = first_by(first_by(hits, [key, "id"], ["rank"]), [key], ["rank", "id"], limit)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("rank", "id"))
    return best.select(key, F.lit("wd").alias("kb"), "id", "label", "description", F.lit("wikidata_hybrid_epg").alias("source"), pos.alias("pos"))


def generated(mentions: DataFrame, index: DataFrame, gazetteer: DataFrame, model: Callable[[str], str], pages: DataFrame | None = None, key: str = "mention_id", order: str = "pos", context: str = "context", **parameters) -> DataFrame:
    """key, kb, id, label, description, source, pos: the candidates of each mention, Wikidata (wd) and GeoNames (gn) apart.

    Lanes in order: search by text; with a context also search by profile, full text
    (pages: title, qid of the search hits of a name, in order) and the gazetteer.
    Mentions of one text and label share the candidates of the first of them by
    ``order``, whose context decides for all.
    """
    once = mentions.groupBy("text", "label").agg(F.min_by(F.struct(F.col(context).alias("context"), F.col(order).alias("o")), order).alias("first"))
    once = once.select("text", "label", "first.context", F.sha2(F.concat_ws("\t", "text", "label"), 256).alias("mention_key"))
    profiles = profiled(once, model, **parameters).where("profile is not null")
    lanes = [searched(once, index), by_profile(profiles, index)]
    names = profiles.select("mention_key", F.col("profile.modern_name").alias("text"))
    if pages is not None:
        hits = names.join(pages.withColumnsRenamed({"name": "_vf_n", "pos": "_vf_pos"}), F.lower("text") == F.lower("_vf_n"))
        first = first_by(hits.where("qid is not null"), ["mention_key"], ["_vf_pos"], PAGES)
        lanes.append(first.select("mention_key", F.lit("wd").alias("kb"), F.col("qid").alias("id"), F.col("title").alias("label"), F.lit("").alias("description"), F.lit("wikipedia_epg").alias("source"), F.col("_vf_pos").cast("int").alias("pos")))
    found = gazetteer_search(names, gazetteer)
    lanes.append(found.select("mention_key", F.lit("gn").alias("kb"), F.concat(F.lit("gn:"), F.col("geonameid").cast("string")).alias("id"), F.col("name").alias("label"), F.lit("").alias("description"), F.lit("geonames_epg").alias("source"), "pos"))
    merged = merged_lanes(lanes).drop("lane")
    back = mentions.select(key, F.sha2(F.concat_ws("\t", "text", "label"), 256).alias("_vf_k"))
    return back.join(merged, F.col("_vf_k") == F.col("mention_key")).select(key, "kb", "id", "label", "description", "source", "pos")


def fetched_labels(ids: DataFrame, fetch: Callable[[list[str]], dict[str, dict[str, str]]], languages: tuple[str, ...] = ("nl", "en"), at_once: int = 50, column: str = "id") -> DataFrame:
    """id, label of each different id: the label in the first language that has one, null without any; ``fetch`` gets at most ``at_once`` ids a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["id"].tolist()
            for k in range(0, len(own), at_once):
                part = own[k : k + at_once]
                said = fetch(part)
                yield pd.DataFrame({"id": part, "label": [next((said[i][c] for c in languages if said.get(i, {}).get(c)), None) for i in part]})

    return ids.select(F.col(column).alias("id")).where("id is not null").distinct().mapInPandas(run, "id string, label string")
