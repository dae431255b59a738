"""Queries of candidate lanes, gold documents and templates over the given tables, with deterministic stand-ins for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow import external
from vellumflow.operators import candidates, gold, pages
from vellumflow.plans.annotation import _PARAGRAPHS, _TOKENS, _gold, query
from vellumflow.session import table


def _index(spark, d):
    """Names of the gazetteer as labels in three languages; the description says whether an entry is land or height."""
    g = table(spark, d, "gazetteer").where("name is not null")
    listed = F.filter(F.split(F.coalesce("alternatenames", F.lit("")), ","), lambda a: F.trim(a) != "")
    rows = g.select("geonameid", "population", F.explode(F.array_distinct(F.concat(F.array("name"), listed))).alias("label"))
    lang = F.get(F.array(F.lit("nl"), F.lit("en"), F.lit("de")), (F.length("label") % 3).cast("int"))
    return rows.select(F.concat(F.lit("Q"), F.col("geonameid").cast("string")).alias("id"), lang.alias("lang"), "label", F.when(F.col("geonameid") % 2 == 0, "hoogte").otherwise("Land").alias("description"), F.col("geonameid").alias("rank"))


_INDEX = """
names as (select geonameid, unnest(list_distinct(list_concat([name], list_filter(string_split(coalesce(alternatenames, ''), ','), lambda a: trim(a) <> '')))) as label from gazetteer where name is not null),
idx as (select 'Q' || geonameid as id, ['nl', 'en', 'de'][length(label) % 3 + 1] as lang, label, case when geonameid % 2 = 0 then 'hoogte' else 'Land' end as description, geonameid as rank from names)
"""
_ONCE = """
once as (select text, label, arg_min(coalesce(letter_id, ''), mention_id) as context from qrank_matched group by 1, 2)
"""


def _once(spark, d):
    m = table(spark, d, "qrank_matched")
    once = m.groupBy("text", "label").agg(F.min_by(F.coalesce("letter_id", F.lit("")), "mention_id").alias("context"))
    return once.withColumn("mention_key", F.concat_ws("|", "text", "label"))


_SEARCHED = """
hit as (select o.text, o.label as kind, i.*, row_number() over (partition by o.text, o.label, lang order by rank, id) as n from once o join idx i on lower(trim(o.text)) = lower(trim(i.label)) where trim(o.text) <> ''),
one as (select *, row_number() over (partition by text, kind, id order by list_position(['nl', 'en', 'de'], lang), rank) as m from hit where n <= 15),
sparse as (select text, kind, id, label, row_number() over (partition by text, kind order by list_position(['nl', 'en', 'de'], lang), rank, id) as pos from one where m = 1)
"""


@query("with " + _INDEX + "," + _ONCE + "," + _SEARCHED + " select concat_ws('|', text, kind) as mention_key, id, label, pos from sparse")
def candidates_searched(spark, d):
    return candidates.searched(_once(spark, d), _index(spark, d)).select("mention_key", "id", "label", "pos")


_PROFILED = """
hyb0 as (select distinct on (o.text, o.label, i.id) o.text, o.label as kind, i.id, i.label, i.rank from once o join idx i on lower(trim(replace(o.text, '"', ''))) = lower(trim(i.label)) where i.lang = 'en' and trim(o.context) <> '' and contains(lower(i.description), case when o.label like '%E18%' then 'hoogte' else 'land' end) order by i.rank, i.label),
hybrid as (select text, kind, id, label, pos from (select *, row_number() over (partition by text, kind order by rank, id) as pos from hyb0) where pos <= 15)
"""


@query("with " + _INDEX + "," + _ONCE + "," + _PROFILED + " select concat_ws('|', text, kind) as mention_key, id, pos from hybrid")
def candidates_by_profile(spark, d):
    profiles = candidates.profiled(_once(spark, d), external.profile_stub).where("profile is not null")
    return candidates.by_profile(profiles, _index(spark, d)).select("mention_key", "id", "pos")


@query(
    "with " + _INDEX + "," + _ONCE + "," + _SEARCHED + "," + _PROFILED
    + """, lanes as (select text, kind, id, 0 as lane, pos from sparse union all select text, kind, id, 1, pos from hybrid), firsts as (select *, row_number() over (partition by text, kind, id order by lane, pos) as n from lanes),
 merged as (select text, kind, id, row_number() over (partition by text, kind order by lane, pos, id) as pos from firsts where n = 1) select m.mention_id, g.id, g.pos from qrank_matched m join merged g on m.text = g.text and m.label = g.kind"""
)
def candidates_generated(spark, d):
    """All lanes for every mention; the SQL says the Wikidata side, the gazetteer side has ``gazetteer_candidates`` and its test."""
    m = table(spark, d, "qrank_matched").select("mention_id", "text", "label", F.coalesce("letter_id", F.lit("")).alias("context"))
    empty = table(spark, d, "gazetteer").where("geonameid is null")
    return candidates.generated(m, _index(spark, d), empty, external.profile_stub, order="mention_id").where("kb = 'wd'").select("mention_id", "id", "pos")


# Gold documents and templates.


def _pages(spark, d):
    return pages.by_rule(table(spark, d, "documents"), "doc_id", rule="\n\n").select(F.col("letter_id").alias("doc_id"), F.col("page").cast("long").alias("page"), "start_off", "text")


_LOCAL = _TOKENS.rstrip().rstrip(",") + ", " + _PARAGRAPHS + r""",
truns as (select doc_id, page, unnest(regexp_extract_all(text, '[^ \t\n\f\r]+|[ \t\n\f\r]+')) as run, generate_subscripts(regexp_extract_all(text, '[^ \t\n\f\r]+|[ \t\n\f\r]+'), 1) as k from pages),
tplaced as (select doc_id, page, run as token, coalesce(sum(length(run)) over (partition by doc_id, page order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start from truns),
ptokens as (select doc_id, page, token, start, start + length(token) as "end", row_number() over (partition by doc_id, page order by start) - 1 as id from tplaced where not regexp_matches(token, '^[ \t\n\f\r]'))
"""


def _page_tokens(spark, d):
    keyed = _pages(spark, d).withColumn("key", F.struct("doc_id", "page"))
    return pages.tokenized(keyed.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("key"), "text"), "key").select(
        F.split("key", "/")[0].cast("long").alias("doc_id"), F.split("key", "/")[1].cast("long").alias("page"), F.col("id").cast("long").alias("id"), "token", "start", "end"
    )


@query(
    "with " + _LOCAL + """, b as (select doc_id, page, start_off, lead(start_off) over (partition by doc_id order by start_off) as end_off from pages), g as (select g.id, g.doc_id, b.page, g.start - b.start_off as start, g."end" - b.start_off + 2 as "end" from gold g join b on g.doc_id = b.doc_id and g.start >= b.start_off and (b.end_off is null or g.start < b.end_off)),
 s as (select g.doc_id, g.page, g.id, min(t.start) as start, max(t."end") as "end" from g join ptokens t on g.doc_id = t.doc_id and g.page = t.page and g.start < t."end" and t.start < g."end" group by 1, 2, 3),
 l as (select doc_id, page, list({'s': start, 'e': "end", 'i': id} order by id) as spans from s group by 1, 2),
 k as (select doc_id, page, list_reduce(list_transform(spans, lambda x: [x]), lambda kept, x: case when list_bool_or(list_transform(kept, lambda k: k.s < x[1].e and x[1].s < k.e)) then kept else list_concat(kept, x) end) as kept from l)
 select doc_id, page, u.i as id, u.s as start, u.e as "end" from (select doc_id, page, unnest(kept) as u from k)"""
)
def gold_documents(spark, d):
    """Spans that reach two characters into what follows grow to the tokens they touch."""
    g = _gold(spark, d).select("doc_id", "id", "start", (F.col("end") + 2).alias("end"))
    docs = gold.documents(g, _pages(spark, d).drop("text"), _page_tokens(spark, d).drop("token"), ["doc_id"])
    return docs.select("doc_id", "page", F.inline("entities")).select("doc_id", "page", F.col("id").cast("long").alias("id"), "start", "end")


@query(
    "with " + _LOCAL + """, o as (select doc_id, page, start_off from pages), e as (select t.doc_id, t.page, t.id, t.start, t."end", t.token as text, case when regexp_matches(token, '^[0-9]') then 'E52_Time_Span' else 'E53_Place' end as label from ptokens t where regexp_matches(token, '^[A-Z0-9]')),
 n as (select *, row_number() over (partition by doc_id, page, lower(text), label order by start, id) as n from e) select n.doc_id, n.page, n.text, n.label, n.start + o.start_off as start_char, n."end" + o.start_off as end_char, '' as wikidata_qid, case when n.id % 2 = 0 then 'gn' || n.id else '' end as geonames_id from n join o using (doc_id, page) where n.n = 1"""
)
def gold_template(spark, d):
    t = _page_tokens(spark, d).where(F.col("token").rlike("^[A-Z0-9]"))
    e = t.select("doc_id", "page", "id", "start", "end", F.col("token").alias("text"), F.when(F.col("token").rlike("^[0-9]"), "E52_Time_Span").otherwise("E53_Place").alias("label"), F.lit(None).cast("string").alias("wd"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("gn"), F.col("id").cast("string"))).alias("gn"))
    return gold.template(e, _pages(spark, d).withColumn("seq", F.col("page")), ["doc_id"])


@query("select doc_id, case when doc_id % 2 = 0 then '{\"n\": ' || doc_id || '}' end as body, case when doc_id % 2 = 0 then 1 else 3 end as attempts, doc_id % 2 = 1 as failed from documents")
def answers_with_json(spark, d):
    """Prompts of every document; a model that gives an object for even ids and prose for odd ones is asked once or three times."""

    def model(prompt: str) -> str:
        n = int(prompt.split()[-1])
        return f'Dit is het: {{"n": {n}}} en meer' if n % 2 == 0 else "geen idee {"

    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Brief "), F.col("doc_id").cast("string")).alias("p"))
    said = external.asked_json(docs, model, "p")
    return docs.join(said, F.col("p") == F.col("prompt")).select("doc_id", "body", "attempts", "failed")


@query(
    r"""select doc_id, md5('Give the transcribed text of each numbered line as JSON {"1": text, ..., "confidence": number}.' || e'\nLines:\n' || array_to_string(list_transform(string_split(text, e'\n'), lambda x, i: i || ': ' || x), e'\n') || e'\nTranscription:\n' || coalesce(source, '')) as lines,
 md5(e'Mention: M\nContext: ' || text || e'\nCandidates:\n1. x\nAnswer with the id of the right candidate, or NIL if none is.') as choice from documents"""
)
def prompts_rendered(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(candidates.lines_prompt(F.split(t, "\n"), F.coalesce("source", F.lit("")))).alias("lines"), F.md5(candidates.choice_prompt(F.lit("M"), t, F.lit("1. x"), rank=False)).alias("choice")
    )
