"""Queries of letters as graphs and routes: each user's events as the events of a letter, whose mentions are numbered."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions.ids import CATEGORIES, LABELS
from vellumflow.operators import graph, lookups, relations, story
from vellumflow.plans.annotation import query
from vellumflow.session import cut, table


def _mention(k, shift: int):
    return F.concat(F.lit("e"), ((k + shift) % 100).cast("string"))


def _answers(spark, d):
    e = table(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "id": F.concat(F.lit("RS_"), F.col("event_id").cast("string"))})
    first = e.groupBy(F.col("user_id").alias("_u")).agg(F.min_by("id", F.struct("ts", "event_id")).alias("first"))
    k, kind = F.col("k"), F.col("event_type")
    e = e.join(first, F.col("user_id") == F.col("_u"))
    body = F.struct(
        "id", F.when(kind == "purchase", "translocation").when(kind == "view", "indoor_tour").when(kind == "click", "outdoor_tour").otherwise("stay").alias("type"), F.concat(F.lit("Reis "), F.col("event_id").cast("string"), F.lit(" met postwagen.")).alias("label"),
        F.when((kind == "error") & (F.col("id") != F.col("first")), F.col("first")).alias("falls_within"), F.when(kind == "purchase", _mention(k, 1)).alias("moved_from"), F.when(kind == "purchase", _mention(k, 0)).alias("moved_to"),
        F.when((kind == "purchase") & (k % 5 == 0), F.array(_mention(k, 2), F.lit("e999"), _mention(k, 7))).alias("via_points"), F.when(kind.isin("click", "signup"), _mention(k, 0)).alias("took_place_at"),
        F.when(kind == "view", _mention(k, 0)).alias("on_or_within"), F.when(kind == "view", F.array(_mention(k, 5))).alias("viewed_artifacts"), F.when(kind == "error", F.array(_mention(k, 0))).alias("near_places"),
        F.when(kind == "click", F.array(_mention(k, 4))).alias("time_span"), F.when(kind == "purchase", F.array(F.struct(_mention(k, 3).alias("mention_id"), F.lit("mode_of_transportation").alias("role")))).alias("citations"),
    )
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", body.alias("b")))), lambda x: x["b"]).alias("events"))
    return lists.select(F.concat(F.lit("BRF"), F.col("user_id").cast("string")).alias("doc_id"), F.to_json(F.struct("events")).alias("body"))


def _mentions(spark, d):
    docs = table(spark, d, "events").select(F.concat(F.lit("BRF"), F.col("user_id").cast("string")).alias("doc")).distinct()
    n = F.col("n")
    rows = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("n"))
    label = F.get(F.array(*map(F.lit, LABELS)), n % len(LABELS))
    text = F.when(label == "Mode_of_Transportation", F.when(n % 3 == 0, "te voet ").otherwise("de wagen ")).otherwise("Plaats é")
    return rows.select("doc", F.concat(F.lit("e"), n.cast("string")).alias("mention_id"), n.alias("pos"), F.concat(text, n.cast("string")).alias("text"), label.alias("label"), F.when(n % 3 == 0, F.concat(F.lit("Q"), n.cast("string"))).alias("wd"), F.when(n % 4 == 0, F.concat(F.lit("gn:"), (n + 1000).cast("string"))).alias("gn"))


def _story(spark, d):
    return story.triples(relations.events(_answers(spark, d)), _mentions(spark, d))


def _label_sql() -> str:
    return "[" + ", ".join(f"'{x}'" for x in LABELS) + f"][n % {len(LABELS)} + 1]"


_KIND_ROWS = ", ".join(f"('{k}', '{v[0]}', {v[2]}, {str(v[3]).lower()}, [{', '.join(repr(c) for c in v[1])}])" for k, v in story.KINDS.items())
_ARTS = "('mode', 'E52_Time_Span', 'F2_Expression')"
_GRAPH = f"""
kinds as (select * from (values {_KIND_ROWS}) k(kind, prefix, cut, with_id, classes)),
docs as (select distinct 'BRF' || user_id as doc from events),
m0 as (select doc, 'e' || n as mention_id, n, {_label_sql()} as label from docs, (select unnest(range(0, 100)) as n)),
m1 as (select *, case when label = 'Mode_of_Transportation' then case when n % 3 = 0 then 'te voet ' else 'de wagen ' end else 'Plaats é' end || n as text, case when label <> 'Mode_of_Transportation' then label when n % 3 = 0 then 'mode' else 'vehicle' end as kind, case when n % 3 = 0 then 'Q' || n end as wd, case when n % 4 = 0 then (n + 1000)::varchar end as gn from m0),
m as (select m1.*, prefix || '.' || left(regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g'), cut) || case when with_id and coalesce(wd, gn) is not null then '_' || coalesce(wd, gn) else '' end as uri, classes from m1 join kinds using (kind)),
e0 as (select *, json_extract_string(props, '$.k')::int as k, 'BRF' || user_id as doc from events),
e as (select *, doc || '.RS.' || event_id as event, doc || '.RS' as journey, first_value(event_id) over (partition by doc order by ts, event_id) as first_id, event_type = 'purchase' as is_move from e0),
p as (select *, event_type = 'error' and event_id <> first_id as nested from e),
r as (select doc, event, ts, event_id, is_move, 'moved_from' as role, 'P27' as prop, 'e' || ((k + 1) % 100) as mention_id, false as told, true as says from p where is_move union all select doc, event, ts, event_id, is_move, 'moved_to', 'P26', 'e' || k % 100, false, true from p where is_move
 union all select doc, event, ts, event_id, is_move, 'took_place_at', 'P7', 'e' || k % 100, false, true from p where event_type in ('click', 'signup') union all select doc, event, ts, event_id, is_move, 'on_or_within', 'P8', 'e' || k % 100, false, true from p where event_type = 'view'
 union all select doc, event, ts, event_id, is_move, 'viewed_artifacts', 'P12', 'e' || ((k + 5) % 100), true, false from p where event_type = 'view' union all select doc, event, ts, event_id, is_move, 'near_places', 'proximity', 'e' || k % 100, false, true from p where event_type = 'error'
 union all select doc, event, ts, event_id, is_move, 'time_span', 'P4', 'e' || ((k + 4) % 100), false, false from p where event_type = 'click' union all select doc, event, ts, event_id, is_move, 'mode', 'P101', 'e' || ((k + 3) % 100), false, true from p where is_move),
u as (select r.*, uri, label, kind, case when role = 'time_span' then case when label = 'E52_Time_Span' then 'P4' end when role = 'mode' then case kind when 'vehicle' then 'P16' when 'mode' then 'P101' end else prop end as property from r join m using (doc, mention_id)),
v as (select doc, event, event || '.VP0001' as sub, 'e' || ((k + 1) % 100) as a, 'e' || ((k + 2) % 100) as b from p where is_move and k % 5 = 0 union all select doc, event, event || '.VP0003', 'e' || ((k + 2) % 100), 'e' || ((k + 7) % 100) from p where is_move and k % 5 = 0),
w as (select v.*, fm.uri as from_uri, tm.uri as to_uri, tm.text as to_text from v join m fm on fm.doc = v.doc and fm.mention_id = a join m tm on tm.doc = v.doc and tm.mention_id = b),
seqs as (select event, row_number() over (partition by doc order by ts, event_id) as seq from p),
says as (select doc, mention_id, event, lpad(seq::varchar, 9, '0') as seq from u join seqs using (event) where says union all select doc, b, sub, '~' from w),
firsts as (select doc, mention_id, arg_min(event, (seq, event)) as event from says group by 1, 2),
touched as (select doc, mention_id from firsts union select doc, mention_id from u where property is not null or told),
rest as (select m.* from m anti join touched using (doc, mention_id)),
cited as (select doc, mention_id, event, text, label, uri from firsts join m using (doc, mention_id) union all select doc, mention_id, doc || '.RS', text, label, uri from rest),
chain as (select event as s, lead(event) over (partition by doc order by ts, event_id) as o from p where not nested),
ev as (select event as x, is_move from p union all select doc || '.RS', true from docs union all select sub, true from w),
t as (
 select doc as s, 'type' as p, 'F2' as o from docs union select doc, 'P129', doc || '.RS' from docs union select doc || '.RS', 'P129i', doc from docs union select doc || '.RS', 'P67i', doc from docs union select doc || '.RS', x, 'TG' from docs, (select unnest(['P11', 'P12']) as x) union select 'TG', 'type', 'E74'
 union select event, 'label', 'Reis ' || event_id || ' met postwagen.' from p union select event, x, 'TG' from p, (select unnest(['P11', 'P12']) as x)
 union select event, 'P10i', case when nested then doc || '.RS.' || first_id else journey end from p union select case when nested then doc || '.RS.' || first_id else journey end, 'P10', event from p union select event, 'P132', journey from p
 union select s, x, o from chain, (select unnest(['P183', 'P182']) as x) where o is not null
 union select x, 'type', unnest(['E1', 'E2', 'E4', 'E5', 'E7', 'E92']) from ev union select x, 'type', 'E9' from ev where is_move
 union select event, property, uri from u where property is not null union select doc, 'P67', uri from u where told
 union select sub, 'label', 'Pass through ' || to_text from w union select sub, 'P10i', event from w union select event, 'P10', sub from w union select sub, x, 'TG' from w, (select unnest(['P11', 'P12']) as x) union select sub, 'P132', event from w union select sub, 'P27', from_uri from w union select sub, 'P26', to_uri from w
 union select 'CT.' || doc || '.' || mention_id, 'type', 'F2' from cited union select 'CT.' || doc || '.' || mention_id, 'label', 'Citation: ''' || text || ''' (' || label || ')' from cited union select 'CT.' || doc || '.' || mention_id, 'P67', uri from cited
 union select uri, 'P67i', 'CT.' || doc || '.' || mention_id from cited union select event, 'conveys', 'CT.' || doc || '.' || mention_id from cited union select doc, 'P67', uri from rest
 union select uri, 'type', unnest(classes) from m union select uri, 'label', text from m union select uri, 'closeMatch', wd from m where wd is not null and kind not in {_ARTS} union select uri, 'closeMatch', gn from m where gn is not null and kind not in {_ARTS})
"""


@query(f"with {_GRAPH} select s, p, o from t")
def story_triples(spark, d):
    return _story(spark, d)


_READ = f"""{_GRAPH},
lab as (select s as x, min(o) as label from t where p = 'label' group by 1), q as (select s as x, min(o) as qid from t where p = 'closeMatch' group by 1),
top as (select distinct s as x from t where p = 'type' and o = 'E53' union select s from t where p = 'type' and o = 'E18' and s not in (select s from t where p = 'type' and o in ('E19', 'E20', 'E22'))),
ref as (select s as ct, max(qid) as qid from t left join q on o = x where p = 'P67' group by 1),
cit as (select t.s as event, string_agg(split_part(t.o, '.', -1), '; ' order by t.o) as citations, list({{'ct': t.o, 'qid': ref.qid}} order by t.o) as listed from t left join ref on t.o = ref.ct where p = 'conveys' group by 1)"""


@query(
    f"""with {_READ}, one as (select s as e, t.p, arg_min(coalesce(label, ''), t.o) as l, arg_min(coalesce(qid, ''), t.o) as q, string_agg(label, '; ' order by t.o) as ls, string_agg(qid, '; ' order by t.o) as qs from t left join lab on lab.x = t.o left join q on q.x = t.o where t.p in ('P27', 'P26', 'P7', 'P8', 'proximity') group by 1, 2),
 steps as (select doc, event, row_number() over (partition by doc order by ts, event_id) as step, count(*) over (partition by doc) as n, first_value(event) over (partition by doc order by ts, event_id) as head from p where not nested),
 rows as (select head, step, event, '' as parent from steps where n > 1 union all select s.head, s.step, c.o, c.s from steps s join t c on c.s = s.event and c.p = 'P10' where n > 1),
 shown as (select head, step::int as step, rows.event as event_id, parent as parent_id, case when parent <> '' then case when wi.e is not null then 'sub_indoor' else 'sub_outdoor/stay' end when mv.s is not null then 'translocation' when wi.e is not null then 'indoor_tour' else 'outdoor_tour/stay' end as type, coalesce(lab.label, '') as label,
 coalesce(fr.l, '') as "from", coalesce(fr.q, '') as from_qid, coalesce(tt.l, '') as "to", coalesce(tt.q, '') as to_qid, coalesce(aa.l, '') as "at", coalesce(aa.q, '') as at_qid, coalesce(wi.l, '') as "within", coalesce(wi.q, '') as within_qid, coalesce(nr.ls, '') as near, coalesce(nr.qs, '') as near_qid,
 case when mv.s is not null and contains(lab.label, ' met ') then rtrim(split_part(lab.label, ' met ', -1), '.') else '' end as mode, coalesce(cit.citations, '') as citations
 from rows left join lab on lab.x = rows.event left join (select s from t where p = 'type' and o = 'E9') mv on mv.s = rows.event left join one fr on fr.e = rows.event and fr.p = 'P27' left join one tt on tt.e = rows.event and tt.p = 'P26'
 left join one aa on aa.e = rows.event and aa.p = 'P7' left join one wi on wi.e = rows.event and wi.p = 'P8' left join one nr on nr.e = rows.event and nr.p = 'proximity' left join cit on cit.event = rows.event)
 select * from shown union all select null, null, '', '', 'mentioned_only', coalesce(label, top.x), '', '', '', '', '', coalesce(qid, ''), '', '', '', '', '', '' from top left join lab using (x) left join q using (x) where top.x not in (select o from t where p in ('P7', 'P26', 'P27', 'proximity'))"""
)
def story_report(spark, d):
    return story.report(_story(spark, d))


@query(
    f"""with {_READ}, md as (select t.s as event, arg_min(label, t.o) as mode from t join lab on lab.x = t.o where t.p = 'P101' group by 1), ts as (select t.s as event, list(label order by label) as spans from t join lab on lab.x = t.o where t.p = 'P4' group by 1), k as (select event from cit union select event from md union select event from ts)
 select event, coalesce(array_to_string(list_transform(listed, lambda c: c.ct || '/' || coalesce(c.qid, '')), '|'), '') as cited, coalesce(mode, '') as mode, coalesce(array_to_string(spans, '|'), '') as spans from k left join cit using (event) left join md using (event) left join ts using (event)"""
)
def story_attributes(spark, d):
    a = story.attributes(_story(spark, d))
    return a.select("event", F.array_join(F.transform("citations", lambda c: F.concat(c["ct"], F.lit("/"), F.coalesce(c["qid"], F.lit("")))), "|").alias("cited"), "mode", F.array_join("time_spans", "|").alias("spans"))


@query(
    f"""with {_READ}, links as (select s, o from t where p = 'P183'), ch as (select s as x from links union select o from links), sub as (select distinct o as x from t where p = 'P10' and s in (select x from ch))
 select (select count(*) from ch where x not in (select x from sub)) as n_top, (select count(*) from sub) as n_sub, (select count(*) from ch where x in (select s from t where p = 'type' and o = 'E9')) as translocations, (select count(*) from ch where x not in (select s from t where p = 'type' and o = 'E9')) as tours,
 (select count(*) from t where p = 'type' and o = 'F2' and s like 'CT.%') as citations, (select count(*) from t where p = 'proximity') as near, (select count(*) from top where x not in (select o from t where p in ('P7', 'P26', 'P27', 'proximity'))) as mentioned_only"""
)
def story_counts(spark, d):
    return story.counts(_story(spark, d))


@query(
    f"""with {_READ}, steps as (select t.o as place, ts, event_id, case when t.p in ('P27', 'P7') then 0 else 1 end as k from t join p on p.event = t.s where t.p in ('P27', 'P26', 'P7', 'P8')), f as (select place, min((ts, event_id, k)) as a from steps group by 1)
 select x as place, (a)[1] as ts, (a)[2] as event_id, (a)[3] as step from top left join f on place = x where x in (select o from t where p in ('P7', 'P8', 'P26', 'P27', 'proximity'))"""
)
def story_places(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("BRF"), F.col("user_id").cast("string"), F.lit(".RS."), F.col("event_id").cast("string")).alias("event"), F.struct("ts", "event_id").alias("seq"))
    rows = lookups.by_first_visit(cut(_story(spark, d)), e)
    return rows.select("place", F.col("seq.ts").alias("ts"), F.col("seq.event_id").alias("event_id"), "step")


_SAID = "['IN', 'NEAR', 'THRU', 'TO', 'FROM', 'NO_REL']"


@query(
    f"""with {_READ}, said as (select 'CT.' || doc || '.' || mention_id as mention, {_SAID}[n % 6 + 1] as category from m where n % 6 < 5 or n % 2 = 1), seen as (select distinct o as x from t where p in ('P7', 'P26', 'P27', 'proximity') and o in (select x from top)),
 lk as (select distinct o as mention from t where p = 'P67i' and o like 'CT%' and s in (select x from seen)), c as (select category, count(*) as total, count(lk.mention) as linked from said left join lk using (mention) group by 1)
 select x.category, coalesce(total, 0) as total, coalesce(linked, 0) as linked, coalesce(total, 0) - coalesce(linked, 0) as not_linked, case when x.category = 'NO_REL' and linked > 0 then 'contamination' when x.category <> 'NO_REL' and total - linked > 0 then 'non-compliance' else '' end as note from (select unnest({_SAID}) as category) x left join c using (category)"""
)
def story_coverage(spark, d):
    n = F.col("pos")
    m = _mentions(spark, d).where((n % 6 < 5) | (n % 2 == 1))
    said = m.select(F.concat(F.lit("CT."), "doc", F.lit("."), "mention_id").alias("mention_id"), F.get(F.array(*map(F.lit, CATEGORIES)), n % 6).alias("category"))
    return lookups.citation_coverage(said, cut(_story(spark, d)), CATEGORIES)


@query("with g as (select 'V' || user_id % 7 as rule, 'S' || event_id % 40 as subject, case when user_id % 7 < 3 then 'error' else 'warn' end as severity from events), n as (select rule, severity, count(*) as n from g group by 1, 2), x as (select rule, severity, subject, row_number() over (partition by rule, severity order by subject) as k from (select distinct * from g)) select n.rule, n.severity, n.n, string_agg(subject, '|' order by subject) as examples from n join x on x.rule = n.rule and x.severity = n.severity where k <= 5 group by 1, 2, 3")
def violations_grouped(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("V"), (F.col("user_id") % 7).cast("string")).alias("rule"), F.when(F.col("user_id") % 7 < 3, "error").otherwise("warn").alias("severity"), F.concat(F.lit("S"), (F.col("event_id") % 40).cast("string")).alias("subject"))
    return lookups.grouped_violations(rows).withColumn("examples", F.array_join("examples", "|"))


assert graph.VISITS == ("P7", "P26", "P27", "proximity")  # what the SQL above says
