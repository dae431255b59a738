"""Editions: lines and entities as ALTO pages, letters as TEI, HTML overlays; plain string aggregation in a fixed order."""

from __future__ import annotations

from collections.abc import Iterator
from io import StringIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import spans_with_ends, tei_tag, xml_escaped


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), xml_escaped(value.cast("string")), F.lit('"'))).otherwise(F.lit(""))


def _joined(struct: Column, what, separator: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(struct)), what), separator)


def tag_table(entities: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tags: the ``OtherTag`` table of a page. entities: keys, tag_id, label, text."""
    one = lambda x: F.concat(F.lit("<OtherTag"), _attribute("ID", x["tag_id"]), _attribute("TYPE", x["label"]), _attribute("LABEL", x["text"]), F.lit("/>"))
    return entities.select(*keys, "tag_id", "label", "text").distinct().groupBy(*keys).agg(_joined(F.struct("tag_id", "label", "text"), one).alias("tags"))


def tag_ids(entities: DataFrame) -> DataFrame:
    """Entities with ``tag_id``: ``ne_<mention>``, or ``ne_g<start>`` without a mention."""
    return entities.withColumn("tag_id", F.when(F.col("mention").isNotNull(), F.concat(F.lit("ne_"), "mention")).otherwise(F.concat(F.lit("ne_g"), F.col("start").cast("string"))))


def alto_pages(words: DataFrame, keys: list[str], tags: DataFrame | None = None) -> DataFrame:
    """keys, xml: one ALTO document for each page.

    words: keys, block_id, block_seq, line_id, line_seq, word_seq, text, x, y, w, h,
    tagrefs. Blocks, lines and words come in their order, so equal input gives equal
    bytes. Words are grouped by line, lines by block, blocks by page.
    """
    word = lambda x: F.concat(
        F.lit("<String"), _attribute("CONTENT", x["text"]), _attribute("HPOS", x["x"].cast("long")), _attribute("VPOS", x["y"].cast("long")), _attribute("WIDTH", x["w"].cast("long")),
        _attribute("HEIGHT", x["h"].cast("long")), F.when(F.coalesce(x["tagrefs"], F.lit("")) != "", _attribute("TAGREFS", x["tagrefs"])).otherwise(F.lit("")), F.lit("/>"),
    )
    lines = words.groupBy(*keys, "block_seq", "block_id", "line_seq", "line_id").agg(_joined(F.struct("word_seq", "text", "x", "y", "w", "h", "tagrefs"), word, "<SP/>").alias("c"))
    blocks = lines.groupBy(*keys, "block_seq", "block_id").agg(_joined(F.struct("line_seq", "line_id", "c"), lambda x: F.concat(F.lit("<TextLine"), _attribute("ID", x["line_id"]), F.lit(">"), x["c"], F.lit("</TextLine>"))).alias("c"))
    pages = blocks.groupBy(*keys).agg(_joined(F.struct("block_seq", "block_id", "c"), lambda x: F.concat(F.lit("<TextBlock"), _attribute("ID", x["block_id"]), F.lit(">"), x["c"], F.lit("</TextBlock>"))).alias("c"))
    pages = pages.withColumn("tags", F.lit("")) if tags is None else pages.join(tags, keys, "left").withColumn("tags", F.coalesce("tags", F.lit("")))
    head = F.when(F.col("tags") != "", F.concat(F.lit("<Tags>"), "tags", F.lit("</Tags>"))).otherwise(F.lit(""))
    return pages.select(*keys, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><alto>'), head, F.lit("<Layout><Page><PrintSpace>"), "c", F.lit("</PrintSpace></Page></Layout></alto>")).alias("xml"))


def tei_body(text: Column, spans: Column) -> Column:
    """A letter's text with its entities as TEI elements, page markers as ``pb``, other text in brackets as editors' notes, line breaks as ``lb``.

    spans: array<struct<start,end,label,ref,key>>, without overlaps. What is escaped
    is escaped once; no character of the text is lost.
    """
    def plain(piece: Column) -> Column:
        marked = F.regexp_replace(xml_escaped(piece), r"\[([IVXLCDM]+|\d+)\]", '<pb n="$1"/>')
        noted = F.regexp_replace(marked, r"\[([^\]]+)\]", '<note type="editorial">$1</note>')
        return F.regexp_replace(noted, r"\n", "<lb/>\n")

    part = lambda start, end: F.substring(text, start.cast("int") + 1, (end - start).cast("int"))

    def piece(x: Column) -> Column:
        s, before = x["s"], x["before"]
        entity = F.concat(plain(part(before, s["start"])), F.lit("<"), tei_tag(s["label"]), _attribute("ref", s["ref"]), _attribute("key", s["key"]), F.lit(">"), plain(part(s["start"], s["end"])), F.lit("</"), tei_tag(s["label"]), F.lit(">"))
        return F.when(s.isNull(), plain(F.substring(text, before.cast("int") + 1, F.length(text)))).otherwise(entity)

    return F.array_join(F.transform(spans_with_ends(F.array_sort(spans)), piece), "")


def tei(letters: DataFrame, entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, xml: one TEI document for each letter. letters: key, text; entities: key, start, end, label, ref, ent_key."""
    spans = entities.groupBy(F.col(key).alias("_vf_k")).agg(F.collect_list(F.struct("start", "end", "label", "ref", F.col("ent_key").alias("key"))).alias("spans"))
    joined = letters.join(spans, F.col(key) == F.col("_vf_k"), "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    body = tei_body(F.coalesce("text", F.lit("")), F.coalesce("spans", empty))
    return joined.select(key, F.concat(F.lit("<TEI><text><body><ab>"), body, F.lit("</ab></body></text></TEI>")).alias("xml"))


def overlay(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html: boxes of a page's lines with their text, as positioned elements. lines: keys, seq, text, x0, y0, x1, y1."""
    one = lambda x: F.concat(
        F.lit('<div class="line" style="left:'), x["x0"].cast("long").cast("string"), F.lit("px;top:"), x["y0"].cast("long").cast("string"), F.lit("px;width:"), (x["x1"] - x["x0"]).cast("long").cast("string"),
        F.lit("px;height:"), (x["y1"] - x["y0"]).cast("long").cast("string"), F.lit('px">'), xml_escaped(F.coalesce(x["text"], F.lit(""))), F.lit("</div>"),
    )
    return lines.where("x0 is not null").groupBy(*keys).agg(F.concat(F.lit("<section>"), _joined(F.struct("seq", "text", "x0", "y0", "x1", "y1"), one), F.lit("</section>")).alias("html"))


def check_loss(letters: DataFrame, editions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lossless: whether an edition without its elements holds the letter's text, markers and notes included."""
    bare = F.regexp_replace("xml", r'<pb n="([^"]*)"/>', "[$1]")
    bare = F.regexp_replace(bare, r'(?s)<note type="editorial">(.*?)</note>', "[$1]")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    own = editions.select(F.col(key).alias("_vf_k"), bare.alias("_vf_b"))
    return letters.join(own, F.col(key) == F.col("_vf_k")).select(key, (F.col("_vf_b") == F.coalesce("text", F.lit(""))).alias("lossless"))


def updated_page_xml(files: DataFrame, corrections: DataFrame) -> DataFrame:
    """path, page_xml, n_updated, error of scans whose lines get corrected texts.

    files: path, page_xml; corrections: path, line_id, text. A line's first TextEquiv
    takes the text as PlainText and Unicode (made where it isn't there); lines without
    a correction, and all else of the file, stay. A file that is no XML comes out as
    it is, with its error.
    """
    import xml.etree.ElementTree as ET

    texts = corrections.where("line_id is not null and text is not null").groupBy(F.col("path").alias("_vf_p")).agg(F.map_from_entries(F.collect_list(F.struct("line_id", "text"))).alias("texts"))
    joined = files.join(texts, F.col("path") == F.col("_vf_p"), "left").select("path", "page_xml", "texts")

    def updated(text: str, own: dict[str, str]) -> tuple[str, int]:
        spaces = dict(e for _, e in ET.iterparse(StringIO(text), events=["start-ns"]))
        for prefix, uri in spaces.items():
            ET.register_namespace(prefix, uri)
        root, n = ET.fromstring(text), 0
        for line in root.iter():
            name = line.tag.rpartition("}")
            if name[2] != "TextLine" or line.get("id") not in own:
                continue
            space = f"{name[0]}}}" if name[1] else ""
            equiv = line.find(f"{space}TextEquiv")
            equiv = ET.SubElement(line, f"{space}TextEquiv") if equiv is None else equiv
            for part in ("PlainText", "Unicode"):
                held = equiv.find(f"{space}{part}")
                held = ET.SubElement(equiv, f"{space}{part}") if held is None else held
                held.text = own[line.get("id")]
            n += 1
        return ET.tostring(root, encoding="unicode"), n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, own in zip(batch["path"], batch["page_xml"], batch["texts"]):
                try:
                    xml, n = updated((text or "").lstrip("\ufeff"), dict(own) if own is not None else {})
                    rows.append((path, xml, n, None))
                except ET.ParseError as fault:
                    rows.append((path, text, 0, str(fault)))
            yield pd.DataFrame(rows, columns=["path", "page_xml", "n_updated", "error"])

    return joined.mapInPandas(run, "path string, page_xml string, n_updated int, error string")


def spliced(pages: DataFrame, graph: DataFrame, keys: list[str]) -> DataFrame:
    """ALTO pages with a letter's graph put in front of their layout, as escaped text; a page without one stays. graph: keys, turtle."""
    known = graph.select(*[F.col(k).alias(f"_vf_{k}") for k in keys], "turtle")
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_vf_{k}")
        on = same if on is None else on & same
    block = F.concat(F.lit("<Description><OtherDescription>"), xml_escaped(F.col("turtle")), F.lit("</OtherDescription></Description>"))
    joined = pages.join(known, on, "left")
    return joined.select(*keys, F.when(F.col("turtle").isNotNull(), F.concat(F.substring_index("xml", "<alto>", 1), F.lit("<alto>"), block, F.substring_index("xml", "<alto>", -1))).otherwise(F.col("xml")).alias("xml"))
