"""Identifiers, names of runs and models, and URI parts, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def kb_id(value: Column) -> Column:
    """A knowledge-base id: trimmed, without ``gn:``; empty, NIL and NONE become null. An ``ERROR:`` text stays."""
    text = F.trim(value)
    return F.when(~F.upper(text).isin("", "NIL", "NONE"), F.regexp_replace(text, "^gn:", ""))


def integral_id(value: Column) -> Column:
    """``kb_id`` with a float written id as an integer (``2935704.0`` -> ``2935704``); nan becomes null."""
    text = kb_id(value)
    return F.when(F.lower(text) != "nan", F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"))


def is_blank(value: Column) -> Column:
    """Whether a value is null, empty, white space or ``nan``."""
    return value.isNull() | F.lower(F.trim(value)).isin("", "nan")


def is_qid(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^Q[0-9]+$"), F.lit(False))


def has_id(value: Column) -> Column:
    """Whether a value names an entity: neither blank nor NIL nor NAN."""
    return ~F.coalesce(F.upper(F.trim(value)).isin("", "NAN", "NIL"), F.lit(True))


def is_error(value: Column) -> Column:
    return F.coalesce(value.startswith("ERROR:"), F.lit(False))


def failure(kb: Column, model: Column, timed_out: Column) -> Column:
    """The sentinel that a failed link leaves in place of an id."""
    return F.concat(F.lit("ERROR:"), model, F.lit(" "), kb, F.when(timed_out, F.lit(" timed out")).otherwise(F.lit(" failed")))


def wikidata_of(url: Column) -> Column:
    """QID in a Wikidata address, null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(url, r"(?i)wikidata\.org/(?:wiki|entity)/(Q\d+)", 1)), F.lit(""))


def geonames_of(url: Column) -> Column:
    """Id in a GeoNames address, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"(?i)geonames\.org/(\d+)", 1), F.lit(""))


def slug(text: Column, kb: Column | None = None, cut: int = 30) -> Column:
    """Non-alphanumeric runs as ``_``, cut, and followed by the slug of a knowledge-base id (cut at 20)."""
    own = F.left(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), F.lit(cut))
    if kb is None:
        return own
    tail = F.left(F.regexp_replace(kb, r"[^A-Za-z0-9]+", "_"), F.lit(20))
    return F.when(tail.isNull() | (tail == ""), own).otherwise(F.concat(own, F.lit("_"), tail))


def entity_uri(base: str, prefix: str, text: Column, kb: Column | None = None) -> Column:
    """``<base><PREFIX>_<slug>`` of a place, vehicle, artefact, time span, ..."""
    cut = 40 if prefix in ("TS", "ART") else 30
    return F.concat(F.lit(f"{base}{prefix}_"), slug(text, kb, cut))


def event_uri(base: str, letter: Column, event: Column) -> Column:
    """Event ids write ``.`` for ``_`` and begin with the letter's id."""
    dotted = F.replace(event, F.lit("_"), F.lit("."))
    return F.concat(F.lit(base), F.when(dotted.startswith(letter), dotted).otherwise(F.concat(letter, F.lit("."), dotted)))


def short_uri(uri: Column) -> Column:
    """What follows the last ``/`` or ``#``."""
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def linking_slug(model: Column) -> Column:
    return F.regexp_replace(model, r"[:/]", "-")


def relation_slug(model: Column) -> Column:
    return F.regexp_replace(model, r"[^a-zA-Z0-9_.-]", "_")


def ner_run(name: Column) -> Column:
    """(source, model, temperature, mode, language) of ``<source>__<model>_t<temp>_<mode>_<language>``; nulls where it doesn't fit."""
    pattern = r"^(.*?)__(.+)_t(\d+(?:\.\d+)?)_([^_]+)_([^_]+)$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(part(1).alias("source"), part(2).alias("model"), part(3).try_cast("double").alias("temperature"), part(4).alias("mode"), part(5).alias("language"))


def linking_run(name: Column) -> Column:
    """(source, model, temperature, think) of ``<source>__<model>_t<temp>_think<think>...``.

    A version written with ``-`` behind the model's name (``gemma4-31b``) is read back with ``:``.
    """
    pattern = r"^(.*)__([^_]+(?:_[^_]+)*?)_t(\d+(?:\.\d+)?)(?:_think([A-Za-z]+))?"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    model = F.regexp_replace(part(2), r"-(\d+(?:\.\d+)?[bB])$", ":$1")
    return F.struct(part(1).alias("source"), model.alias("model"), part(3).try_cast("double").alias("temperature"), part(4).alias("think"))


def relation_run(name: Column) -> Column:
    """(model, temperature, think) of the last ``__`` part of ``<source>__..__<model>_t<temp>[_think<Mode>][_events]``; think in small letters, nulls where it doesn't fit."""
    base = F.regexp_replace(name, "_events$", "")
    last = F.when(F.contains(base, F.lit("__")), F.substring_index(base, "__", -1))
    pattern = r"^(.+)_t(\d+\.?\d*)(?:_think(\w+))?$"
    thinking = r"^(.+)_t(\d+\.?\d*)_think(\w+)$"
    part = lambda k: F.nullif(F.coalesce(F.nullif(F.regexp_extract(last, thinking, k), F.lit("")), F.regexp_extract(last, pattern, k)), F.lit(""))
    return F.struct(part(1).alias("model"), part(2).try_cast("double").alias("temperature"), F.lower(part(3)).alias("think"))


def scan_number(filename: Column) -> Column:
    """Last ``_`` part of a file's stem as a number."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "_"), -1).try_cast("int")


def letter_label(path: Column, short: bool = False) -> Column:
    """Stem of a path; short: its first ``_`` part."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.split(stem, "_")[0] if short else stem


def config_label(model: Column, think: Column, temperature: Column) -> Column:
    thought = F.when(think.isNull() | think.isin("", "false", "False"), F.lit("")).otherwise(F.concat(F.lit(" think="), think))
    return F.concat(model, thought, F.lit(" t="), temperature.cast("string"))


def winner(delta: Column, above: str, below: str, equal: str = "tie") -> Column:
    return F.when(delta > 0, above).when(delta < 0, below).when(delta == 0, equal)


#: Entity labels.
LABELS = ("E53_Place", "E18_Physical_Thing", "Mode_of_Transportation", "E52_Time_Span", "F2_Expression", "E19_Physical_Object", "E20_Biological_Object", "E31_Document")
#: Labels that are never linked.
NOT_LINKED = ("Mode_of_Transportation", "E52_Time_Span", "F2_Expression", "E19_Physical_Object", "E20_Biological_Object", "E31_Document")
#: Label of a tagging body, by a part of its id (in this order), else by its value.
TYPE_BY_ID = [("E53", "E53_Place"), ("E18", "E18_Physical_Thing"), ("E52", "E52_Time_Span"), ("E31", "E31_Document"), ("E19", "E19_Physical_Object"), ("E20", "E20_Biological_Object"), ("F2", "F2_Expression")]
TYPE_BY_VALUE = {
    "E53 Place": "E53_Place", "E18 Physical Thing": "E18_Physical_Thing", "E52 Time-Span": "E52_Time_Span", "E31 Document": "E31_Document", "E19 Physical Object": "E19_Physical_Object",
    "E20 Biological Object": "E20_Biological_Object", "Mode of Transportation": "Mode_of_Transportation", "F2 Expression": "F2_Expression",
}
#: Tags of a letter's annotators and their labels, by the beginning of the letter's name.
TAG_MAPS = {
    "1816": TYPE_BY_VALUE | {"E22 Human-made Object": "Mode_of_Transportation", "Mode_of_Transportation": "Mode_of_Transportation"},
    "1809": TYPE_BY_VALUE | {"Mode_of_Transportation": "Mode_of_Transportation"},
}
#: Readable names of the labels, for models that take them as prompts.
ALIASES = {
    "place or location": "E53_Place", "building or physical structure": "E18_Physical_Thing", "mode of transportation": "Mode_of_Transportation", "time or date": "E52_Time_Span",
    "artistic or creative expression": "F2_Expression", "movable physical object": "E19_Physical_Object", "biological object": "E20_Biological_Object", "specific document, book or publication": "E31_Document",
}
#: Spatial categories.
CATEGORIES = ("IN", "NEAR", "THRU", "TO", "FROM", "NO_REL")
#: Category that each role of an event stands for.
ROLE_CATEGORY = {"moved_from": "FROM", "moved_to": "TO", "via_points": "THRU", "took_place_at": "IN", "on_or_within": "IN", "near_places": "NEAR"}


def mapped(value: Column, table: dict[str, str]) -> Column:
    """``value`` looked up in a small fixed table; null if it isn't there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def cidoc_type(identifier: Column, value: Column, by_id: list[tuple[str, str]], by_value: dict[str, str]) -> Column:
    """First type whose key stands in the identifier, in the table's order, else the type of the value."""
    first = reduce(lambda rest, kv: F.when(F.contains(identifier, F.lit(kv[0])), F.lit(kv[1])).otherwise(rest), reversed(by_id), F.lit(None).cast("string"))
    return F.coalesce(first, mapped(value, by_value)) if by_value else first


def nanos_to_millis(nanos: Column) -> Column:
    return F.bround(nanos / 1_000_000, 0).cast("long")
