"""Text functions over annotated letters, and parsers of model answers."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Terms too broad to filter places by.
BROAD_TERMS = (
    "germany", "deutschland", "duitsland", "france", "frankrijk", "netherlands", "nederland", "belgium", "belgie", "belgië",
    "europe", "europa", "austria", "oostenrijk", "switzerland", "zwitserland", "italy", "italie", "italië", "luxembourg", "luxemburg",
)
#: Characters stripped from the ends of a token.
TOKEN_PUNCTUATION = ".,;:!?\"'()[]…‘’“”·"
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bare_token(token: Column) -> Column:
    """A token without punctuation at its ends."""
    return F.btrim(token, F.lit(TOKEN_PUNCTUATION))


def without_marker(text: Column) -> Column:
    """A page's text without its leading ``[12]`` or ``[XIV]`` marker."""
    return F.regexp_replace(text, r"^\[[IVXLCDM\d]+\]\s*", "")


def roman(value: Column) -> Column:
    """Number of a Roman numeral, null for other texts; a letter below the one after it counts negative."""
    letters = F.filter(F.split(F.upper(value), ""), lambda c: c != "")
    table = F.create_map(*[F.lit(x) for kv in _ROMAN.items() for x in kv])
    numbers = F.transform(letters, lambda c: F.element_at(table, c))
    total = F.aggregate(
        F.reverse(numbers),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, n: F.struct((acc["sum"] + F.when(n < acc["last"], -n).otherwise(n)).alias("sum"), n.alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(value.rlike(r"(?i)^[IVXLCDM]+$"), total)


#: How far the tables of Roman numerals go that two of the sort keys look up.
_TABLES = {"to_xl": 40, "to_xx": 20}


def page_sort(page: Column, compat: str = "tuple") -> Column:
    """Sort key of a page label.

    ``tuple``: numbers, then Roman numerals, then others. ``lookup``: Roman
    numerals before numbers (as front matter). ``to_xl``, ``to_xx``: as ``lookup``,
    but numerals beyond XL or XX are others, as in a table that ends there. ``int``:
    numbers only.
    """
    number, numeral = page.try_cast("int"), roman(page)
    if compat == "int":
        return number
    if compat in _TABLES:
        numeral = F.when((numeral <= _TABLES[compat]) & (F.upper(page) == page), numeral)
    order = (0, 1) if compat == "tuple" else (1, 0)
    return F.when(number.isNotNull(), F.struct(F.lit(order[0]).alias("kind"), number.alias("n"))).when(
        numeral.isNotNull(), F.struct(F.lit(order[1]).alias("kind"), numeral.alias("n"))
    ).otherwise(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("n")))


def context(text: Column, start: Column, end: Column, window: int | None = None) -> Column:
    """Text around a span (the whole text without a window), line breaks as spaces."""
    if window is None:
        return F.translate(text, "\n", " ")
    low = F.greatest(start - window, F.lit(0))
    return F.translate(F.substring(text, low + 1, end + window - low), "\n", " ")


def location_terms(text: Column) -> Column:
    """Terms between commas and semicolons: trimmed, lower-case, longer than three letters, not too broad."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;]\s*"), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: (F.length(x) > 3) & ~x.isin(*BROAD_TERMS))


#: Ways of travelling in general, words of vehicles, words that single one out.
GENERIC_MODES = ("walking", "wandelen", "wandeling", "te voet", "te paard", "per schip", "per boot", "varen", "vliegen", "rijden")
VEHICLE_WORDS = ("wagen", "rytuig", "rijtuig", "koets", "kar", "karos", "chaise", "postwagen", "extrapost", "diligence", "sjees", "calèche", "barouchette", "munstersche")
SINGLING_WORDS = ("de", "het", "een", "onze", "mijn")


def specific_vehicle(text: Column) -> Column:
    """Whether a mode names one vehicle: general modes don't, then vehicle words and singling words do (the first two anywhere in the text)."""
    low = F.lower(F.trim(text))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(holds(GENERIC_MODES), False).when(holds(VEHICLE_WORDS), True).otherwise(F.arrays_overlap(F.split(low, r"\s+"), F.array(*map(F.lit, SINGLING_WORDS))))


def rerank_scores(answer: Column, n: Column) -> Column:
    """Scores (0 to 1) of n candidates from a ranking answer.

    Lines that begin with a place, a mark and a number (``1: 8.5``, ``2) 7``) score
    that place, the last one counts. If all come to 0, the lines that are a bare
    number score the candidates in turn. What has no score has 0.
    """
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(x))
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    said = r"^(\d+)\s*[):.\-_]\s*(\d+(?:[.,]\d+)?)"
    numbered = F.transform(
        F.filter(lines, lambda x: x.rlike(said)), lambda x: F.struct(F.regexp_extract(x, said, 1).try_cast("int").alias("k"), number(F.regexp_extract(x, said, 2)).alias("v"))
    )
    bare = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+(?:[.,]\d+)?$")), number)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    by_number = F.transform(places, lambda k: F.coalesce(F.get(F.reverse(F.filter(numbered, lambda s: s["k"] == k)), F.lit(0))["v"], F.lit(0.0)) / 10)
    by_place = F.transform(places, lambda k: F.coalesce(F.get(bare, k - 1), F.lit(0.0)) / 10)
    return F.when(F.exists(by_number, lambda v: v != 0), by_number).otherwise(by_place)


def selected_id(answer: Column, candidates: Column) -> Column:
    """Id that a selecting answer names, null (NIL) for none.

    First ``Q123``, then ``gn:123`` (prefix kept), then NIL, then the first candidate
    whose id stands in the text, then an answer that is a bare number as the place in
    the list. A Q-id that is no candidate counts.
    """
    qid = F.nullif(F.regexp_extract(answer, r"(Q\d+)", 1), F.lit(""))
    gn = F.nullif(F.regexp_extract(answer, r"(gn:\d+)", 1), F.lit(""))
    listed = F.get(F.filter(candidates, lambda c: F.contains(answer, c)), F.lit(0))
    place = F.trim(answer).try_cast("int")
    return F.when(qid.isNotNull(), qid).when(gn.isNotNull(), gn).when(F.upper(answer).contains("NIL"), None).otherwise(F.coalesce(listed, F.when(place > 0, F.get(candidates, place - 1))))


#: How the lane of a candidate is shown.
SOURCE_TAGS = {"wikidata_text": "[Wikidata]", "wikidata_hybrid_epg": "[Wikidata]", "wikipedia_epg": "[Wikipedia]", "geonames_epg": "[GeoNames]"}


def candidate_list(candidates: Column) -> Column:
    """Numbered text of array<struct<id,label,description,source>>: id and tag, then label and description on lines of their own."""
    from vellumflow.functions.ids import mapped

    return F.array_join(
        F.transform(
            candidates,
            lambda c, i: F.concat(
                (i + 1).cast("string"), F.lit(". "), c["id"], F.lit(" "), F.coalesce(mapped(c["source"], SOURCE_TAGS), F.lit("")),
                F.lit("\n   Naam: "), F.coalesce(c["label"], F.lit("")), F.lit("\n   Beschrijving: "), F.coalesce(c["description"], F.lit("")),
            ),
        ),
        "\n",
    )


def xml_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: TEI element of each label; others are ``rs``.
TEI_TAGS = {"E53_Place": "placeName", "E21_Person": "persName", "E39_Actor": "persName", "E74_Group": "orgName", "E52_Time-Span": "date"}


def tei_tag(label: Column) -> Column:
    from vellumflow.functions.ids import mapped

    return F.coalesce(mapped(label, TEI_TAGS), F.lit("rs"))


def entity_refs(wd: Column, gn: Column) -> Column:
    """struct<ref, key>: addresses of both knowledge bases and the first id there is; nulls without any."""
    ref = F.concat_ws(" ", F.concat(F.lit("http://www.wikidata.org/entity/"), wd), F.concat(F.lit("https://sws.geonames.org/"), gn, F.lit("/")))
    return F.struct(F.nullif(ref, F.lit("")).alias("ref"), F.coalesce(wd, gn).alias("key"))


def event_kind(is_move: Column, within: Column) -> Column:
    """translocation, indoor_tour (something is visited from within) or outdoor_tour/stay."""
    return F.when(is_move, "translocation").when(within.isNotNull(), "indoor_tour").otherwise("outdoor_tour/stay")


def mode_of(label: Column) -> Column:
    """What follows the last `` met `` of a label, without closing stops; null if there is none."""
    return F.when(F.contains(F.lower(label), F.lit(" met ")), F.rtrim(F.substring_index(label, " met ", -1), F.lit(".")))


def _closed(text: str, at: int) -> tuple[tuple[int, int] | None, int | None]:
    """(first brace from ``at`` on that closes, with its end; first brace that stands in quotes), read from the brace at ``at``."""
    open_: list[int] = []
    quoted, best, hidden = False, None, None
    for m in _MARKS.finditer(text, at):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted:
            hidden = m.start() if c == "{" and hidden is None else hidden
        elif c == "{":
            open_.append(m.start())
        elif c == "}":
            start = open_.pop()
            best = (start, m.end()) if best is None or start < best[0] else best
            if not open_:
                break
    return best, hidden


def balanced_object(text: str | None) -> str | None:
    """First balanced ``{...}`` of a text, aware of quotes and escapes inside it.

    A brace may never close, and its quotes may hide the one that does: the braces in
    quotes are read once more, from the first of them on, so two passes tell.
    """
    at = -1 if text is None else text.find("{")
    if at < 0:
        return None
    best, hidden = _closed(text, at)
    if hidden is not None and (best is None or hidden < best[0]):
        other, _ = _closed(text, hidden)
        best = other if best is None or other is not None and other[0] < best[0] else best
    return text[best[0] : best[1]] if best else None


# An escaped character, a quote or a brace.
_MARKS = re.compile(r'\\.|["{}]', re.S)


@F.pandas_udf(StringType())
def json_in(answers: pd.Series) -> pd.Series:
    """The JSON object in a model's answer: out of code fences and prose."""
    def one(a: str | None) -> str | None:
        if a is None:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)```", a, re.S)
        return balanced_object(fenced[1]) if fenced and "{" in fenced[1] else balanced_object(a)

    return answers.map(one)


def line_numbers(mapping: Column) -> Column:
    """A map of text keys with the keys as numbers; keys that are none are left out."""
    return F.map_from_entries(F.filter(F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))), lambda e: e["k"].isNotNull()))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts (Ratcliff/Obershelp), white space normalised; 0 if one is null."""
    clean = lambda x: " ".join(x.split())
    return pd.Series([difflib.SequenceMatcher(None, clean(x), clean(y), autojunk=False).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


def spans_with_ends(ordered: Column) -> Column:
    """array<struct<s,before>>: each span of a sorted array with where the one before it ends (0 before the first), and a last element with a null span."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(ordered, lambda s: s["end"].cast("long")))
    return F.transform(F.arrays_zip(ordered.alias("s"), ends.alias("before")), lambda x: F.struct(x["s"].alias("s"), x["before"].alias("before")))


def markup(text: Column, spans: Column) -> Column:
    """``[text](LABEL, eN)`` put into a text; spans: array<struct<start,end,label,id>>, without overlaps."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"), s["id"].alias("id"))))

    def piece(x: Column) -> Column:
        s, before = x["s"], x["before"].cast("int")
        entity = F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("]("), s["label"], F.lit(", "), s["id"], F.lit(")"))
        return F.when(s.isNull(), F.substring(text, before + 1, F.length(text))).otherwise(entity)

    return F.array_join(F.transform(spans_with_ends(ordered), piece), "")


def commenting(bodies: Column) -> Column:
    """Text of the first commenting body of an annotation, null if there is none."""
    return F.get(F.filter(bodies, lambda b: b["purpose"] == "commenting"), F.lit(0))["value"]


def note_of(comment: Column, wd: Column, gn: Column, most: int = 80) -> Column:
    """The beginning of a comment that gives no id, empty otherwise."""
    return F.when((F.coalesce(comment, F.lit("")) != "") & wd.isNull() & gn.isNull(), F.substring(comment, 1, most)).otherwise(F.lit(""))


#: Prompt cap in characters.
PROMPT_CAP = 200_000


def capped(prompt: Column, cap: int = PROMPT_CAP) -> Column:
    return F.substring(prompt, 1, cap)
