"""Events read from model answers: flattening, checks, and the relation of each place mentioned.

Answers are VARIANT: sub-events may be objects or ids, relations an object or a
list. Everything is flattened to rows by expressions; the depth of sub-events is
bounded by ``DEPTH``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions.ids import CATEGORIES, ROLE_CATEGORY

#: Levels of sub-events that are read.
DEPTH = 4
# Fields of an event that name one mention, and those that list some, in order of precedence.
ONE = ("moved_from", "moved_to", "took_place_at", "on_or_within", "mode_of_transportation", "falls_within")
MANY = ("via_points", "viewed_artifacts", "mentions_places", "near_places", "time_span")
PRECEDENCE = ("moved_from", "moved_to", "via_points", "took_place_at", "on_or_within", "near_places")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def events(answers: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """doc, event_id, parent_id, depth, seq, type, label, falls_within, v (the event as a variant).

    seq is the event's path of places (``0002.0000``), so text order is document
    order. Answers that are no JSON, or have no events, give no row; sub-events that
    are ids only are given by ``sub_event_ids``.
    """
    top = answers.select(F.col(doc).alias("doc"), F.try_variant_get(F.try_parse_json(body), "$.events", "array<variant>").alias("list"))
    level = top.select("doc", F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("prefix"), F.posexplode("list").alias("k", "v"))
    found = []
    for depth in range(DEPTH):
        rows = level.where(F.schema_of_variant("v").startswith("OBJECT")).select(
            "doc", _text(F.col("v"), "$.id").alias("event_id"), "parent_id", F.lit(depth).alias("depth"), F.concat("prefix", F.lpad(F.col("k").cast("string"), 4, "0")).alias("seq"),
            _text(F.col("v"), "$.type").alias("type"), _text(F.col("v"), "$.label").alias("label"), F.nullif(_text(F.col("v"), "$.falls_within"), F.lit("null")).alias("falls_within"), "v",
        )
        found.append(rows)
        level = rows.select("doc", F.col("event_id").alias("parent_id"), F.concat("seq", F.lit(".")).alias("prefix"), F.posexplode(F.try_variant_get("v", "$.sub_events", "array<variant>")).alias("k", "v"))
    return reduce(DataFrame.unionByName, found)


def roles(flat: DataFrame) -> DataFrame:
    """doc, event_id, depth, seq, role, mention_id, pos: every mention that an event refers to."""
    one = F.array(*[F.struct(F.lit(r).alias("role"), _text(F.col("v"), f"$.{r}").alias("mention_id"), F.lit(0).alias("pos")) for r in ONE])
    many = [
        F.transform(F.coalesce(F.try_variant_get("v", f"$.{r}", "array<string>"), F.array().cast("array<string>")), lambda m, i: F.struct(F.lit(r).alias("role"), m.alias("mention_id"), i.alias("pos")))
        for r in MANY
    ]
    cited = F.transform(
        F.coalesce(F.try_variant_get("v", "$.citations", "array<struct<mention_id:string,role:string>>"), F.array().cast("array<struct<mention_id:string,role:string>>")),
        lambda c, i: F.struct(F.concat(F.lit("citation:"), F.coalesce(c["role"], F.lit(""))).alias("role"), c["mention_id"].alias("mention_id"), i.alias("pos")),
    )
    rows = flat.select("doc", "event_id", "depth", "seq", F.inline(F.concat(one, *many, cited)))
    return rows.where("mention_id is not null and mention_id not in ('', 'null')")


def toponym_relations(answers: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """doc, mention_id, category from an object (mention -> category) or a list of pairs; of repeated mentions the last, incomplete ones dropped."""
    v = F.try_variant_get(F.try_parse_json(F.col(body)), "$.toponym_relations", "variant")
    kind = F.schema_of_variant(v)
    pairs = F.when(
        kind.startswith("ARRAY"),
        F.transform(
            F.try_variant_get(v, "$", "array<variant>"),
            lambda x, i: F.struct(i.alias("pos"), F.try_variant_get(x, "$.mention_id", "string").alias("mention_id"), F.try_variant_get(x, "$.category", "string").alias("category")),
        ),
    ).when(
        kind.startswith("OBJECT"),
        F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,string>")), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("mention_id"), e["value"].alias("category"))),
    )
    rows = answers.select(F.col(doc).alias("doc"), F.inline(pairs)).where("mention_id is not null and category is not null")
    last = Window.partitionBy("doc", "mention_id").orderBy(F.desc("pos"))
    return rows.withColumn("_vf_n", F.row_number().over(last)).where("_vf_n = 1").select("doc", "mention_id", F.regexp_replace("category", "^NO REL$", "NO_REL").alias("category"))


def issues(flat: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc, issue, subject, detail of a document's events.

    dangling: a role refers to no mention; category: none of the six; missing: a
    toponym has no relation; inconsistent: a role stands for another category than
    the relation says. mentions: doc, mention_id, is_toponym.
    """
    used = roles(flat)
    known = mentions.select("doc", "mention_id")
    dangling = used.where(~F.col("role").isin("falls_within")).join(known, ["doc", "mention_id"], "left_anti").select("doc", F.lit("dangling").alias("issue"), F.col("mention_id").alias("subject"), F.col("role").alias("detail"))
    category = relations.where(~F.col("category").isin(*CATEGORIES)).select("doc", F.lit("category").alias("issue"), F.col("mention_id").alias("subject"), F.col("category").alias("detail"))
    missing = mentions.where("is_toponym").join(relations, ["doc", "mention_id"], "left_anti").select("doc", F.lit("missing").alias("issue"), F.col("mention_id").alias("subject"), F.lit("").alias("detail"))
    from vellumflow.functions.ids import mapped

    expected = used.withColumn("expected", mapped(F.col("role"), ROLE_CATEGORY)).where("expected is not null").join(relations, ["doc", "mention_id"])
    other = expected.groupBy("doc", "mention_id", "category").agg(F.array_sort(F.collect_set("expected")).alias("e")).where(~F.array_contains("e", F.col("category")))
    inconsistent = other.select("doc", F.lit("inconsistent").alias("issue"), F.col("mention_id").alias("subject"), F.concat("category", F.lit(" / "), F.array_join("e", ", ")).alias("detail"))
    return reduce(DataFrame.unionByName, (dangling, category, missing, inconsistent)).distinct()


def predictions(flat: DataFrame, relations: DataFrame, toponyms: DataFrame, top_only: bool = True) -> DataFrame:
    """doc, mention_id, category of every toponym: its stated relation, else its first role in event order, else NO_REL."""
    from vellumflow.functions.ids import mapped

    used = roles(flat)
    used = used.where("depth = 0") if top_only else used
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("role"))
    by_role = used.where(F.col("role").isin(*PRECEDENCE)).select("doc", "mention_id", mapped(F.col("role"), ROLE_CATEGORY).alias("category"), F.lit(1).alias("source"), F.concat("seq", F.lit("/"), rank.cast("string")).alias("at"))
    stated = relations.where(F.col("category").isin(*CATEGORIES)).select("doc", "mention_id", "category", F.lit(0).alias("source"), F.lit("").alias("at"))
    default = toponyms.select("doc", "mention_id", F.lit("NO_REL").alias("category"), F.lit(2).alias("source"), F.lit("").alias("at"))
    together = stated.unionByName(by_role).unionByName(default).join(toponyms.select("doc", "mention_id").distinct(), ["doc", "mention_id"], "left_semi")
    first = Window.partitionBy("doc", "mention_id").orderBy("source", "at", "category")
    return together.withColumn("_vf_n", F.row_number().over(first)).where("_vf_n = 1").select("doc", "mention_id", "category")


def mentioned_only(relations: DataFrame, said: DataFrame) -> DataFrame:
    """doc, mention_id, status of NO_REL places against those a model listed: both, extra (listed only), missing."""
    own = relations.where("category = 'NO_REL'").select("doc", "mention_id", F.lit(1).alias("_d"))
    other = said.select("doc", "mention_id", F.lit(1).alias("_s")).distinct()
    status = F.when(F.col("_d").isNull(), "extra").when(F.col("_s").isNull(), "missing").otherwise("both")
    return own.join(other, ["doc", "mention_id"], "full").select("doc", "mention_id", status.alias("status"))


def role_map(flat: DataFrame) -> DataFrame:
    """doc, mention_id, roles (a sorted set), events (distinct, in order of first use)."""
    used = roles(flat)
    firsts = used.groupBy("doc", "mention_id", "event_id").agg(F.min("seq").alias("seq"), F.collect_set("role").alias("r"))
    return firsts.groupBy("doc", "mention_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("roles"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_id"))), lambda x: x["event_id"]).alias("events")
    )


def report(relations: DataFrame, flat: DataFrame) -> DataFrame:
    """doc, category, n, n_linked: mentions of each category, and how many an event refers to."""
    linked = roles(flat).select("doc", "mention_id").distinct().withColumn("_l", F.lit(1))
    return relations.join(linked, ["doc", "mention_id"], "left").groupBy("doc", "category").agg(F.count(F.lit(1)).alias("n"), F.count("_l").alias("n_linked"))


def annotated(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions numbered e1..eN in page and text order, then those inside another one left out."""
    from vellumflow.operators.spans import not_contained

    numbered = mentions.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "id")))
    return not_contained(numbered, keys).withColumn("mention", F.concat(F.lit("e"), F.col("number").cast("string")))
