"""Queries of the training-data problems on text (2, 4, 5, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import canonical, langid, leaks, mixture, scans, visual
from vellumflow.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.linked(table(spark, sf_dir, "qrank_matched"), table(spark, sf_dir, "gazetteer"))
    return found.select("mention_id", "geonameid").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "qrank_matched")
    return visual.not_plain(mentions, "mention_id", ["text", "wikidata_label"]).select("mention_id", "field")


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both values of each mention in their one consistent form."""
    mentions = table(spark, sf_dir, "qrank_matched").select("mention_id", "text", "wikidata_label")
    return visual.normalized(mentions, ["text", "wikidata_label"]).select("mention_id", "text_plain", "wikidata_label_plain")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(table(spark, sf_dir, "page_scans")).distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "page_scans"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak no item, by their keys."""
    return leaks.clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "source", "n_chars")


def p7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "declared", "found", F.col("confidence").alias("doc_confidence"), F.inline_outer("passages")).drop("n_sentences")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.where("wrong").select("doc_id", F.explode("held").alias("lang"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_normalized, p5_found, p5_paragraphs, p6_found, p6_clean, p7_selected, p7_shares, p8_found, p8_passages)}
# A value is not in plain form if it isn't composed, holds a wide form, a ligature, another space or hyphen or something invisible, or mixes Latin with Greek or Cyrillic.
_NOT_PLAIN = r"""
nfc_normalize(v) <> v
or regexp_matches(v, '[\p{Cf}\x{034F}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{2212}\x{FF01}-\x{FF5E}\x{FB00}-\x{FB06}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{0132}\x{0133}]')
or (regexp_matches(v, '\p{Latin}') and regexp_matches(v, '[\p{Greek}\p{Cyrillic}]'))
"""
SQL: dict[str, str] = {
    "p4_found": f"select mention_id, field from (select mention_id, 'text' as field, text as v from qrank_matched union all select mention_id, 'wikidata_label', wikidata_label from qrank_matched) where {_NOT_PLAIN}"
}
