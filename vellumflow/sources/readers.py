"""Readers of letters, scans, annotations, gold tables, gazetteers, graphs and run files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumflow.functions.ids import geonames_of, integral_id, letter_label, mapped, scan_number, wikidata_of
from vellumflow.functions.text import strip_bom

# Names of the columns of a gazetteer dump, by place.
_GAZETTEER = {0: "geonameid", 1: "name", 2: "asciiname", 3: "alternatenames", 4: "lat", 5: "lon", 6: "feature_class", 7: "feature_code", 8: "country_code", 10: "admin1_code", 14: "population", 15: "elevation"}


def letters(spark: SparkSession, path: str) -> DataFrame:
    """letter_id, text of whole text files, without a byte-order mark."""
    files = spark.read.text(path, wholetext=True).select(letter_label(F.col("_metadata.file_path")).alias("letter_id"), strip_bom(F.col("value")).alias("text"))
    return files


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """path, scan, page_xml of PAGE-XML files as strings, for ``page_lines``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), scan_number(F.col("_metadata.file_path")).alias("scan"), F.col("value").alias("page_xml"))


def page_lines(files: DataFrame, order: str = "index") -> DataFrame:
    """path, region_idx, line_idx, region_id, line_id, coords, baseline, plain_text, unicode_text, conf, error of PAGE-XML.

    order: ``index`` sorts the references of the reading order by their index and
    appends regions that have none; ``document`` takes the references as they stand
    and only the regions they name. Lines without an id get one from their place. A
    file that is no XML gives one row with its error and nothing else.
    """
    import xml.etree.ElementTree as ET

    schema = "path string, region_idx int, line_idx int, region_id string, line_id string, coords string, baseline string, plain_text string, unicode_text string, conf double, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda e: e.tag.rpartition("}")[2]
        kids = lambda e, name: [x for x in e if local(x) == name]
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["page_xml"]):
                try:
                    root = ET.fromstring((text or "").lstrip("﻿"))
                except ET.ParseError as fault:
                    rows.append((path, *[None] * 9, str(fault)))
                    continue
                regions = [x for x in root.iter() if local(x) == "TextRegion"]
                refs = [(int(x.get("index") or 10**9), k, x.get("regionRef")) for k, x in enumerate(root.iter()) if local(x) == "RegionRefIndexed"]
                if order == "index":
                    refs.sort()
                ids = [r for *_, r in refs]
                known = {x.get("id"): x for x in regions}
                listed = [known[i] for i in dict.fromkeys(ids) if i in known]
                if order == "index":
                    listed += [x for x in regions if x.get("id") not in ids]
                for r, region in enumerate(listed):
                    for k, line in enumerate(kids(region, "TextLine")):
                        points = lambda name: next((x.get("points") for x in kids(line, name)), None)  # noqa: B023, E731
                        equiv = next(iter(kids(line, "TextEquiv")), None)
                        said = lambda name: None if equiv is None else next((x.text or "" for x in kids(equiv, name)), None)  # noqa: B023, E731
                        conf = None if equiv is None else equiv.get("conf")
                        rows.append((path, r, k, region.get("id") or f"r{r}", line.get("id") or f"r{r}l{k}", points("Coords"), points("Baseline"), said("PlainText"), said("Unicode"), float(conf) if conf else None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "page_xml").mapInPandas(read, schema)


def scan_map(spark: SparkSession, path: str) -> DataFrame:
    """scan, page, pos (place in the file) of a scan map; pages are texts (Roman numerals)."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.col(raw.columns[0]).try_cast("int").alias("scan"), F.trim(F.col(raw.columns[1])).alias("page"), F.monotonically_increasing_id().alias("pos"))
    return rows.where("scan is not null")


def page_to_scan(mapping: DataFrame) -> DataFrame:
    """page, scan: of a page that is mapped repeatedly the last row of the file."""
    return mapping.groupBy("page").agg(F.max_by("scan", "pos").alias("scan"))


def page_texts(lines: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, scan, text; page, line_idx, start, end, line_id) of read pages in scan order, lines joined by line breaks.

    lines: scan, region_idx, line_idx, line_id, text. Scans that aren't mapped and
    pages without any text are left out; a line's span takes in the break behind it.
    """
    scans = page_to_scan(mapping)
    held = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(scans, "scan")
    pages = held.groupBy("page", "scan").agg(F.array_sort(F.collect_list(F.struct("region_idx", "line_idx", "line_id", "text"))).alias("l"))
    texts = F.transform("l", lambda x: x["text"])
    rows = pages.select("page", "scan", F.posexplode(F.transform("l", lambda x: F.struct(x["line_id"].alias("line_id"), x["text"].alias("text")))).alias("line_idx", "x"))
    before = Window.partitionBy("page", "scan").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("x.text") + 1).over(before), F.lit(0)).cast("long")
    spans = rows.withColumn("start", start).select("page", "line_idx", "start", (F.col("start") + F.length("x.text") + 1).alias("end"), "x.line_id")
    return pages.select("page", "scan", F.array_join(texts, "\n").alias("text")), spans


def pages_in_range(lines: DataFrame, mapping: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of the scans whose printed page lies in a range, with ``page``, in the order of their scans."""
    numbered = page_to_scan(mapping).withColumn("n", F.col("page").try_cast("int")).where(F.col("n").between(first, last))
    return lines.join(numbered.select("scan", "page"), "scan").orderBy("scan", "region_idx", "line_idx")


def is_empty_page(lines: DataFrame) -> DataFrame:
    """scan, text (lines joined by spaces), empty: whether a read page holds nothing but white space."""
    pages = lines.groupBy("scan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "line_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"))
    return pages.withColumn("empty", F.trim("text") == "")


_BODY = "array<struct<type:string,id:string,value:string,purpose:string,geometry:struct<type:string,coordinates:array<double>>>>"
_SELECTOR = "array<struct<type:string,start:bigint,`end`:bigint,exact:string>>"
ANNOTATION = f"id string, type string, generated string, body {_BODY}, target struct<source:string,label:string,selector:{_SELECTOR}>"


def annotations(spark: SparkSession, path: str, tags: dict[str, str] | None = None) -> DataFrame:
    """id, tag, label, start, end, exact, comment, wd, gn, lon, lat of web annotations.

    tag is the value of the first tagging body, label its name in ``tags`` (the tag
    itself without a table; null if it isn't in it). Annotations without a tagging
    body or without a position are left out.
    """
    raw = spark.read.schema(ANNOTATION).json(path, multiLine=True)
    of = lambda purpose: F.get(F.filter("body", lambda b: b["purpose"] == purpose), F.lit(0))
    place = F.get(F.filter("target.selector", lambda s: s["type"] == "TextPositionSelector"), F.lit(0))
    quote = F.get(F.filter("target.selector", lambda s: s["type"] == "TextQuoteSelector"), F.lit(0))
    tag, comment = of("tagging")["value"], of("commenting")["value"]
    point = of("georeferencing")["geometry"]["coordinates"]
    said = F.concat_ws(" ", comment, of("identifying")["id"], of("identifying")["value"])
    rows = raw.select("id", tag.alias("tag"), (mapped(tag, tags) if tags else tag).alias("label"), place["start"].alias("start"), place["end"].alias("end"), quote["exact"].alias("exact"), comment.alias("comment"), wikidata_of(said).alias("wd"), geonames_of(said).alias("gn"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))
    return rows.where("tag is not null and start is not null and end is not null")


def gold_links(spark: SparkSession, path: str) -> DataFrame:
    """text, label, start, end, wd, gn, note of a gold table; rows with bad offsets are left out."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns])
    return raw.select("text", "label", F.col("start_char").try_cast("int").alias("start"), F.col("end_char").try_cast("int").alias("end"), integral_id(F.col("wikidata_qid")).alias("wd"), integral_id(F.col("geonames_id")).alias("gn"), "note").where("start is not null and end is not null")


def gold_relations(spark: SparkSession, path: str, labels: tuple[str, ...] = ("E53_Place", "E18_Physical_Thing")) -> DataFrame:
    """Gold relations: toponyms with a visited_type, ``NO REL`` as NO_REL."""
    raw = spark.read.csv(path, header=True)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns])
    return raw.where(F.col("label").isin(*labels) & (F.trim("visited_type") != "")).withColumn("visited_type", F.replace(F.trim("visited_type"), F.lit("NO REL"), F.lit("NO_REL")))


def mention_map(spark: SparkSession, path: str) -> DataFrame:
    """mention_id, text, label, wd, gn, start, end of a mention map (one object keyed by id)."""
    kind = "map<string,struct<text:string,label:string,kb_id_wikidata:string,kb_id_geonames:string,start:bigint,`end`:bigint>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("mention_id", "m"))
    return rows.select("mention_id", "m.text", "m.label", F.col("m.kb_id_wikidata").alias("wd"), F.col("m.kb_id_geonames").alias("gn"), "m.start", "m.end")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer dump: tab-separated, no quoting, at least 11 fields; bad numbers become 0."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    number = {"geonameid": "long", "lat": "double", "lon": "double", "population": "long", "elevation": "int"}
    columns = [F.coalesce(F.get("f", F.lit(k)).try_cast(number[n]), F.lit(0)).cast(number[n]).alias(n) if n in number else F.get("f", F.lit(k)).alias(n) for k, n in _GAZETTEER.items()]
    return parts.select(*columns)


def popularity_dump(spark: SparkSession, path: str) -> DataFrame:
    """entity, qrank of a popularity dump (csv, also compressed)."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("Entity").alias("entity"), F.col("QRank").try_cast("long").alias("qrank")).where("entity is not null")


def score_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A score log with an enforced schema; lines that don't fit keep their text in ``_corrupt_record``."""
    return spark.read.csv(path, header=True, schema=f"{schema}, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def error_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Error logs of many runs with model, temperature, mode and language of their file names."""
    from vellumflow.functions.ids import ner_run

    rows = spark.read.csv(path, header=True, schema=schema).withColumn("_run", ner_run(letter_label(F.col("_metadata.file_path"))))
    return rows.select("*", "_run.*").drop("_run")


def run_info(spark: SparkSession, path: str) -> DataFrame:
    """path, body of run-info JSON files, for ``operators.drift``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def offset_map(spark: SparkSession, path: str) -> DataFrame:
    """page, start_full of an offset map."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("page", "start_full"))




def turtle_triples(text: str) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, o_is_literal) of a Turtle subset: prefixes, ``a``, ``;``, ``,``, plain literals. Names are resolved to full addresses."""
    prefixes: dict[str, str] = {}
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    for m in re.finditer(r"@prefix\s+([\w-]*):\s*<([^>]*)>\s*\.", text):
        prefixes[m[1]] = m[2]
    text = re.sub(r"@prefix[^\n]*\n?", "", text)

    def full(name: str) -> str:
        head, colon, tail = name.partition(":")
        return prefixes[head] + tail if colon and head in prefixes else name

    out, s, p = [], None, None
    for m in re.finditer(r'<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^[^\s;,]+|@[\w-]+)?|([;,.])(?=\s|$)|([^\s;,<"]+?)(?=\s|[;,]|\.(?:\s|$)|$)', text):
        iri, literal, mark, name = m.groups()
        if mark == ".":
            s = p = None
        elif mark == ";":
            p = None
        elif mark == ",":
            pass
        else:
            value = iri if iri is not None else literal if literal is not None else full(name)
            if s is None:
                s = value
            elif p is None:
                p = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if name == "a" else value
            else:
                out.append((s, p, re.sub(r"\\(.)", r"\1", value) if literal is not None else value, literal is not None))
    return out


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """path, s, p, o, o_is_literal of Turtle files; triples of a file are a set."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *t) for path, text in zip(batch["path"], batch["value"]) for t in dict.fromkeys(turtle_triples(text or ""))]
            yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "o_is_literal"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(read, "path string, s string, p string, o string, o_is_literal boolean")
