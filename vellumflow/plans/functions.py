"""Queries of column functions and parsers over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions import ids
from vellumflow.functions import text as tx
from vellumflow.operators import drift, geometry, linking, lookups, pages, relations, runs, spans
from vellumflow.plans.annotation import _TOKENS, _gold, _line_rows, _nested_spans, _pred, _tokens, query
from vellumflow.plans.problems import _LINES_SQL
from vellumflow.session import table

_T = _TOKENS.rstrip().rstrip(",")


@query(
    r"select mention_id, nullif(upper(regexp_extract('zie https://www.wikidata.org/wiki/' || lower(wikidata_qid) || ' en', '(?i)wikidata\.org/(?:wiki|entity)/(Q[0-9]+)', 1)), '') as wd, nullif(regexp_extract('http://www.geonames.org/' || geonames_id || '/x.html', '(?i)geonames\.org/([0-9]+)', 1), '') as gn from qrank_matched"
)
def ids_in_addresses(spark, d):
    wd = F.concat(F.lit("zie https://www.wikidata.org/wiki/"), F.lower("wikidata_qid"), F.lit(" en"))
    gn = F.concat(F.lit("http://www.geonames.org/"), "geonames_id", F.lit("/x.html"))
    return table(spark, d, "qrank_matched").select("mention_id", ids.wikidata_of(wd).alias("wd"), ids.geonames_of(gn).alias("gn"))


def _types_sql() -> str:
    said = "replace(replace(label, '_', ' '), 'Time Span', 'Time-Span')"
    tag = "case when mention_id % 3 = 0 then 'https://x/' || label else 'https://x/y' end"
    by_id = " ".join(f"when contains({tag}, '{k}') then '{v}'" for k, v in ids.TYPE_BY_ID)
    by_value = " ".join(f"when {said} = '{k}' then '{v}'" for k, v in ids.TYPE_BY_VALUE.items())
    return f"select mention_id, case {by_id} {by_value} end as type from qrank_matched"


@query(_types_sql())
def types_of_tags(spark, d):
    said = F.replace(F.replace("label", F.lit("_"), F.lit(" ")), F.lit("Time Span"), F.lit("Time-Span"))
    tag = F.when(F.col("mention_id") % 3 == 0, F.concat(F.lit("https://x/"), "label")).otherwise(F.lit("https://x/y"))
    return table(spark, d, "qrank_matched").select("mention_id", ids.cidoc_type(tag, said, ids.TYPE_BY_ID, ids.TYPE_BY_VALUE).alias("type"))


@query(
    "select geonameid, list_filter(list_transform(string_split_regex(coalesce(alternatenames, '') || '; Deutschland, aan, ' || coalesce(name, ''), '[,;] *'), lambda x: lower(trim(x))), lambda x: length(x) > 3 and x not in ("
    + ", ".join(f"'{t}'" for t in tx.BROAD_TERMS)
    + ")) as terms from gazetteer"
)
def location_terms(spark, d):
    hint = F.concat(F.coalesce("alternatenames", F.lit("")), F.lit("; Deutschland, aan, "), F.coalesce("name", F.lit("")))
    return table(spark, d, "gazetteer").select("geonameid", tx.location_terms(hint).alias("terms"))


_SAID = "case mention_id % 5 when 0 then 'Te voet naar ' || text when 1 then 'een ' || text when 2 then text || ' per postwagen' when 3 then 'wandeling met de wagen' else text end"


def _modes_sql() -> str:
    holds = lambda words: " or ".join(f"contains(t, '{w}')" for w in words)
    singles = ", ".join(f"'{w}'" for w in tx.SINGLING_WORDS)
    return f"with m as (select mention_id, lower(trim({_SAID})) as t from qrank_matched) select mention_id, case when {holds(tx.GENERIC_MODES)} then false when {holds(tx.VEHICLE_WORDS)} then true else list_has_any(regexp_split_to_array(t, '[ \\t\\n\\f\\r]+'), [{singles}]) end as specific from m"


@query(_modes_sql())
def specific_vehicles(spark, d):
    k = F.col("mention_id") % 5
    said = F.when(k == 0, F.concat(F.lit("Te voet naar "), "text")).when(k == 1, F.concat(F.lit("een "), "text")).when(k == 2, F.concat("text", F.lit(" per postwagen"))).when(k == 3, "wandeling met de wagen").otherwise(F.col("text"))
    return table(spark, d, "qrank_matched").select("mention_id", tx.specific_vehicle(said).alias("specific"))


@query(
    "with a as (select mention_id, mention_id % 9 as k from qrank_matched) select mention_id, round(case when mention_id % 5 = 0 then 0.4 when mention_id % 5 = 1 then 0 else (k + 0.5) / 10 end, 6) as first, case when mention_id % 5 = 0 then 0.85 when mention_id % 5 = 1 then 0 else 0.7 end::double as second, 0.0::double as third from a"
)
def rerank_answers(spark, d):
    """Scores out of answers: numbered lines (the last of a number counts), bare numbers, or prose without any."""
    k = (F.col("mention_id") % 9).cast("string")
    numbered = F.concat(F.lit("Zo dan:\n1: 9\n1: "), k, F.lit(",5\n2) 7.0 want\n3 - geen\n9: 3"))
    answer = F.when(F.col("mention_id") % 5 == 0, "4\n 8.5 \nniets").when(F.col("mention_id") % 5 == 1, "geen idee").otherwise(numbered)
    scores = tx.rerank_scores(answer, F.lit(3))
    return table(spark, d, "qrank_matched").select("mention_id", *[F.round(F.get(scores, F.lit(i)), 6).alias(c) for i, c in enumerate(("first", "second", "third"))])


@query("select mention_id, case mention_id % 7 when 0 then 'Q' || mention_id when 1 then 'gn:77' when 2 then null when 3 then '66' when 4 then '66' when 5 then null when 6 then null end as id from qrank_matched")
def selected_ids(spark, d):
    """What an answer selects: a QID, a prefixed id, NIL, an id of the list, a place in the list, a place beyond it, nothing."""
    k = F.col("mention_id") % 7
    q = F.concat(F.lit("Het is Q"), F.col("mention_id").cast("string"), F.lit(", niet gn:3"))
    answer = F.when(k == 0, q).when(k == 1, "gn:77 past").when(k == 2, "nil, want 55").when(k == 3, "kandidaat 66 past").when(k == 4, " 2 ").when(k == 5, "9").otherwise("geen idee")
    return table(spark, d, "qrank_matched").select("mention_id", tx.selected_id(answer, F.array(F.lit("55"), F.lit("66"))).alias("id"))


@query("with f as (select file_id, ltrim(body, chr(65279)) as b from run_files) select file_id, case when json_valid(b) and json_type(b) = 'OBJECT' then md5(trim(b, e' \\t\\r\\n')) end as h from f")
def json_in_answers(spark, d):
    """The object of a run file out of an answer that wraps it in prose with braces and a code fence; null where the file holds none."""
    bare = F.btrim(F.regexp_replace("body", "^﻿", ""), F.lit(" \t\r\n"))
    answer = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("Zeker (geen {):\n```json\n"), bare, F.lit("\n```\nklaar"))).otherwise(F.concat(F.lit("Dit dan: "), bare, F.lit(" {einde")))
    files = table(spark, d, "run_files").withColumn("ok", drift.parsed("body").isNotNull())
    return files.select("file_id", F.when(F.col("ok"), F.md5(tx.json_in(answer))).alias("h"))


@query(r"select doc_id, md5(text) as arabic, md5(text) as roman, md5(regexp_replace(text, '^\[[IVXLCDM0-9]+\][ \t\n\f\r]*', '')) as none from documents")
def markers_stripped(spark, d):
    n = (F.col("doc_id") % 99).cast("string")
    strip = lambda *parts: F.md5(F.regexp_replace(tx.without_marker(F.concat(*parts)), "^#", ""))
    return table(spark, d, "documents").select("doc_id", strip(F.lit("["), n, F.lit("]  #"), "text").alias("arabic"), strip(F.lit("[XIV]\n#"), F.col("text")).alias("roman"), F.md5(tx.without_marker(F.col("text"))).alias("none"))


@query(
    "select event_id, case when event_type = 'purchase' then 'translocation' when event_id % 2 = 0 then 'indoor_tour' else 'outdoor_tour/stay' end as kind, case when event_id % 3 = 0 then 'wagen ' || event_id when event_id % 3 = 1 then 'B' end as mode from events"
)
def event_kinds(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id").cast("string")
    label = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Reis met A met wagen "), n, F.lit("."))).when(F.col("event_id") % 3 == 1, "Tocht met B..").otherwise("Verblijf")
    within = F.when(F.col("event_id") % 2 == 0, F.lit("L"))
    return e.select("event_id", tx.event_kind(F.col("event_type") == "purchase", within).alias("kind"), tx.mode_of(label).alias("mode"))


@query("select country_code, string_agg(n || '. ' || geonameid || ' [GeoNames]' || e'\\n   Naam: ' || coalesce(name, '') || e'\\n   Beschrijving: ' || coalesce(feature_code, ''), e'\\n' order by n) as list from (select *, row_number() over (partition by country_code order by geonameid) as n from gazetteer) group by 1")
def candidate_lists(spark, d):
    c = table(spark, d, "gazetteer").groupBy("country_code").agg(F.array_sort(F.collect_list(F.struct("geonameid", "name", "feature_code"))).alias("c"))
    listed = F.transform("c", lambda x: F.struct(x["geonameid"].cast("string").alias("id"), x["name"].alias("label"), x["feature_code"].alias("description"), F.lit("geonames_epg").alias("source")))
    return c.select("country_code", tx.candidate_list(listed).alias("list"))


@query("select o_orderkey, list_sort([o_custkey, o_orderkey + 7000000]) as keys from orders")
def line_numbers(spark, d):
    m = F.create_map(F.col("o_custkey").cast("string"), F.lit("a"), F.lit("x1"), F.lit("c"), (F.col("o_orderkey") + 7_000_000).cast("string"), F.lit("b"))
    return table(spark, d, "orders").select("o_orderkey", F.array_sort(F.map_keys(tx.line_numbers(m))).alias("keys"))


# Spans.

_WIDE = _TOKENS + 'wide as (select doc_id, id, start, lead("end", 2) over (partition by doc_id order by id) as far from tokens), s as (select doc_id, id * 2 as id, start, "end" from tokens where regexp_matches(token, \'^[A-Z]\') union all select doc_id, id * 2 + 1, start, far from wide where id % 2 = 0 and far is not null)'


@query("with " + _WIDE + ', n as (select *, row_number() over (partition by doc_id order by start, id) as number from s), m as (select *, max("end") over (partition by doc_id order by start, "end" desc, id rows between unbounded preceding and 1 preceding) as m from n) select doc_id, id, \'e\' || number as mention from m where m is null or "end" > m')
def mentions_numbered(spark, d):
    return relations.annotated(_nested_spans(spark, d).withColumn("id", F.col("id").cast("long")), ["doc_id"]).select("doc_id", "id", "mention")


def _greedy_sql(order: str) -> str:
    listed = f"l as (select doc_id, list({{'s': start, 'e': \"end\", 'i': id}} order by {order}) as spans from s group by doc_id)"
    fold = "list_reduce(list_transform(spans, lambda x: [x]), lambda kept, x: case when list_bool_or(list_transform(kept, lambda k: k.s < x[1].e and x[1].s < k.e)) then kept else list_concat(kept, x) end)"
    return "with " + _WIDE + f", {listed} select doc_id, unnest({fold}).i as id from l"


@query(_greedy_sql('start - "end", id'))
def spans_greedy_longest(spark, d):
    return spans.greedy(_nested_spans(spark, d), ["doc_id"], "longest").select("doc_id", F.inline("kept")).select("doc_id", F.col("id").cast("long").alias("id"))


@query(_greedy_sql("id"))
def spans_greedy_input(spark, d):
    return spans.greedy(_nested_spans(spark, d), ["doc_id"], "input").select("doc_id", F.inline("kept")).select("doc_id", F.col("id").cast("long").alias("id"))


@query("with " + _T + ", other as (select id, doc_id, start, \"end\", case when id % 3 = 0 then 'E18_Physical_Thing' else label end as label from pred)" + ' select g.id, p.id as r_id, g.label as gold_label, p.label as pred_label from gold g join other p on g.doc_id = p.doc_id and g.start < p."end" and p.start < g."end" and g.label <> p.label')
def spans_mislabelled(spark, d):
    other = _pred(spark, d).withColumn("label", F.when(F.col("id") % 3 == 0, "E18_Physical_Thing").otherwise(F.col("label")))
    rows = runs.mislabelled(_gold(spark, d), other, ["doc_id"])
    return rows.select("id", "r_id", F.col("label").alias("gold_label"), F.col("r_label").alias("pred_label"))


@query("select o_orderpriority as label, o_orderkey as path from (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)) where n = 1")
def runs_best_existing(spark, d):
    there = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("path"))
    runs_ = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("rank"), F.col("o_orderkey").alias("path"))
    return runs.best_existing(runs_, there, "label", "rank", "path").select("label", "path")


@query("select o_custkey as key, o_orderkey as path from (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as n from orders) where n = 1")
def sidecars_matched(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("path"))
    return runs.matching_sidecar(files, "key", "priority", "path").select("key", "path")


# Look-ups.


@query("with " + _T + ', m as (select doc_id, start, "end", \'e\' || id as mention_id, token from tokens where id % 2 = 0), s as (select doc_id, id, start, "end", lower(token) as text from tokens) select s.doc_id, s.id, max(m.mention_id) as mention_id from s left join m on s.doc_id = m.doc_id and s.start = m.start and s."end" = m."end" and lower(s.text) = lower(m.token) group by 1, 2')
def mentions_looked_up(spark, d):
    t = _tokens(spark, d).withColumn("id", F.col("id").cast("long"))
    own = t.select("doc_id", "id", "start", "end", F.lower("token").alias("text"))
    known = t.where("id % 2 = 0").select("doc_id", "start", "end", F.concat(F.lit("e"), F.col("id").cast("string")).alias("mention_id"), F.col("token").alias("text"))
    return lookups.with_mention(own, known, ["doc_id"]).select("doc_id", "id", "mention_id")


@query("with old as (select text, label, letter_id, max(wikidata_qid) as w, max(geonames_id) as g from qrank_matched where mention_id % 2 = 0 group by 1, 2, 3) select m.mention_id, coalesce(case when mention_id % 3 <> 0 then m.wikidata_qid end, w) as wikidata_qid, g as geonames_id from qrank_matched m left join old on m.text = old.text and m.label = old.label and m.letter_id = old.letter_id")
def ids_transferred(spark, d):
    m = table(spark, d, "qrank_matched")
    new = m.select("mention_id", "text", "label", "letter_id", F.when(F.col("mention_id") % 3 != 0, F.col("wikidata_qid")).alias("wikidata_qid"), F.lit(None).cast("string").alias("geonames_id"))
    return lookups.transferred(new, m.where("mention_id % 2 = 0"), ["text", "label", "letter_id"], ["wikidata_qid", "geonames_id"]).select("mention_id", "wikidata_qid", "geonames_id")


@query("select p_partkey, s_suppkey as scan from part left join supplier on p_size = s_suppkey")
def scans_of_pages(spark, d):
    mapping = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("page"), F.col("s_suppkey").alias("scan"))
    return lookups.with_scan(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("page")), mapping).select("p_partkey", "scan")


@query("select o_orderkey from orders where o_custkey % 10 = 0 and o_orderstatus = 'F' and o_orderpriority = '2-HIGH'")
def runs_without_failures(spark, d):
    log = table(spark, d, "orders").withColumn("count_failed_pages", F.col("o_custkey") % 10)
    return lookups.without_failures(log, o_orderstatus="F", o_orderpriority="2-HIGH").select("o_orderkey")


@query("select file_id, contains(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '__') as is_run from run_files")
def files_of_runs(spark, d):
    return table(spark, d, "run_files").select("file_id", lookups.is_run(ids.letter_label(F.col("path"))).alias("is_run"))


@query("with " + _T + " select g.id, substring(d.text, greatest(g.start - 12, 0)::int + 1, (g.start - greatest(g.start - 12, 0))::int) as before, substring(d.text, g.start::int + 1, (g.\"end\" - g.start)::int) as said, substring(d.text, g.\"end\"::int + 1, 12) as after from gold g join documents d using (doc_id) where g.label = 'E53_Place' and regexp_matches(substring(d.text, g.start::int + 1, (g.\"end\" - g.start)::int), '(?i)berg|dorf|VEN')")
def errors_shown(spark, d):
    g = _gold(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("_d"), "text"), F.col("doc_id") == F.col("_d"))
    return lookups.shown(g, "text", "start", "end", "E53_Place", "berg|dorf|VEN", 12, "label").select("id", "before", "said", "after")


@query("select o_orderkey, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 30")
def report_head(spark, d):
    return lookups.head(table(spark, d, "orders"), [F.asc("o_orderpriority"), F.desc("o_totalprice")], 30, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n <= 8")
def rows_limited(spark, d):
    return lookups.limited(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 8).select("o_custkey", "o_orderkey")


@query(
    """with f as (select file_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || case when file_id % 2 = 0 then '_el' else '' end as stem from run_files), s as (select file_id, regexp_replace(stem, '_el$', '') as b from f),
 x as (select file_id, case when contains(b, '__') then split_part(b, '__', 1) else split_part(b, '_el', 1) end as source from s), g as (select distinct case when length(source) % 3 = 0 then source || '.csv' when length(source) % 3 = 1 then source || '_el_gs.csv' else 'other.csv' end as name from x)
 select file_id, case when source || '.csv' in (select name from g) then source || '.csv' when source || '_el_gs.csv' in (select name from g) then source || '_el_gs.csv' else 'default.csv' end as gold from x"""
)
def gold_of_files(spark, d):
    stem = ids.letter_label(F.col("path"))
    files = table(spark, d, "run_files").select("file_id", F.when(F.col("file_id") % 2 == 0, F.concat(stem, F.lit("_el"))).otherwise(stem).alias("stem"))
    base = F.regexp_replace("stem", "_el$", "")
    source = F.when(F.contains(base, F.lit("__")), F.substring_index(base, "__", 1)).otherwise(F.substring_index(base, "_el", 1))
    size = F.length(source) % 3
    golds = files.select(F.when(size == 0, F.concat(source, F.lit(".csv"))).when(size == 1, F.concat(source, F.lit("_el_gs.csv"))).otherwise("other.csv").alias("name")).distinct()
    return lookups.gold_of(files, golds, "default.csv").select("file_id", "gold")


@query("select l_linenumber, count(distinct (l_returnflag, l_linestatus)) as n_pairs, count(distinct l_returnflag) as n_a, count(distinct l_linestatus) as n_b from lineitem group by 1")
def pairs_unique(spark, d):
    return lookups.unique_pairs(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"])


@query("select c.class, count(l.label) as n, round(count(l.label) / (select count(*) from qrank_matched where label in ('E53_Place', 'E18_Physical_Thing', 'E99_None'))::double, 9) as share from (values ('E53_Place'), ('E18_Physical_Thing'), ('E99_None')) c(class) left join qrank_matched l on l.label = c.class group by 1")
def labels_distribution(spark, d):
    return lookups.distribution(table(spark, d, "qrank_matched"), "label", ("E53_Place", "E18_Physical_Thing", "E99_None")).withColumn("share", F.round("share", 9))


@query(
    """with n as (select unnest(range(1, 60)) as n), r as (select n, case when n >= 50 then 'L' when n >= 40 then 'XL' else repeat('X', (n // 10)::int) end || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as label from n),
 p as (select p_partkey, p_size, case p_partkey % 4 when 0 then p_size::varchar when 1 then r.label when 2 then lower(r.label) else 'p' || p_size end as page from part join r on r.n = p_size)
 select p_partkey, page, case p_partkey % 4 when 0 then 0 when 3 then 2 else 1 end as tuple_kind, case p_partkey % 4 when 3 then 0 else p_size end as tuple_n,
 case p_partkey % 4 when 0 then 1 when 1 then case when p_size <= 40 then 0 else 2 end else 2 end as xl_kind, case p_partkey % 4 when 0 then 1 when 1 then case when p_size <= 20 then 0 else 2 end else 2 end as xx_kind, case when p_partkey % 4 = 0 then p_size end as int_n from p"""
)
def pages_sorted(spark, d):
    n = F.col("p_size")
    tens = F.when(n >= 50, "L").when(n >= 40, "XL").otherwise(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")))
    label = F.concat(tens, F.get(F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]), (n % 10).cast("int")))
    k = F.col("p_partkey") % 4
    page = F.when(k == 0, n.cast("string")).when(k == 1, label).when(k == 2, F.lower(label)).otherwise(F.concat(F.lit("p"), n.cast("string")))
    rows = table(spark, d, "part").select("p_partkey", page.alias("page")).withColumn("s", lookups.sort_kinds(F.col("page")))
    return rows.select("p_partkey", "page", F.col("s.tuple.kind").alias("tuple_kind"), F.col("s.tuple.n").alias("tuple_n"), F.col("s.to_xl.kind").alias("xl_kind"), F.col("s.to_xx.kind").alias("xx_kind"), F.col("s.int").alias("int_n"))


# Names of runs, notes, samples, counts.


@query(
    r"""with n as (select file_id, case file_id % 5 when 0 then 'brief__el-m_t0.1__re-m' || file_id || '_t0.' || file_id % 10 || '_thinkHigh_events' when 1 then 'brief__m_t1_events' when 2 then 'brief_geen' when 3 then 'a__b_x_t0.5_thinkDefault' else 'a__b' end as name from run_files)
 select file_id, case file_id % 5 when 0 then 're-m' || file_id when 1 then 'm' when 3 then 'b_x' end as model, case file_id % 5 when 0 then (file_id % 10) / 10.0 when 1 then 1.0 when 3 then 0.5 end::double as temperature, case file_id % 5 when 0 then 'high' when 3 then 'default' end as think from n"""
)
def relation_runs(spark, d):
    k, n = F.col("file_id") % 5, F.col("file_id").cast("string")
    long = F.concat(F.lit("brief__el-m_t0.1__re-m"), n, F.lit("_t0."), (F.col("file_id") % 10).cast("string"), F.lit("_thinkHigh_events"))
    name = F.when(k == 0, long).when(k == 1, "brief__m_t1_events").when(k == 2, "brief_geen").when(k == 3, "a__b_x_t0.5_thinkDefault").otherwise("a__b")
    return table(spark, d, "run_files").select("file_id", ids.relation_run(name).alias("r")).select("file_id", "r.*")


@query("select mention_id, case when coalesce(letter_id, '') <> '' and wikidata_qid is null and geonames_id is null then left(letter_id || ' ' || repeat(text, 9), 80) else '' end as note from qrank_matched")
def notes_of_comments(spark, d):
    m = table(spark, d, "qrank_matched")
    comment = F.when(F.coalesce("letter_id", F.lit("")) != "", F.concat("letter_id", F.lit(" "), F.repeat("text", F.lit(9))))
    return m.select("mention_id", tx.note_of(comment, F.col("wikidata_qid"), F.col("geonames_id")).alias("note"))


@query("with r as (select entity, qrank, row_number() over (order by qrank desc, entity) as rank from qrank), t as (select distinct round_even(pow(10.0, i * (3.2 / 199)), 0)::bigint as rank from (select unnest(range(0, 200)) as i)) select entity, qrank, rank from r where rank in (select rank from t)")
def popularity_sampled(spark, d):
    ranked = linking.popularity(table(spark, d, "qrank")).select("entity", "qrank", F.col("rank").cast("long").alias("rank"))
    return linking.sampled(ranked, 200, 3.2)


@query(
    "with " + _T + r""", parts as (select doc_id, unnest(string_split(text, e'\n')) as raw, generate_subscripts(string_split(text, e'\n'), 1) as k from documents),
 c0 as (select doc_id, k, raw, coalesce(sum(length(raw) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as raw_start from parts), c1 as (select *, raw_start + length(raw) as raw_end from c0 where trim(raw) <> ''),
 s as (select doc_id, id, start - 1 as start, "end" as "end" from gold), a as (select s.*, c.k from s left join c1 c on c.doc_id = s.doc_id and s.start <= c.raw_end and s.start > coalesce((select max(raw_end) from c1 x where x.doc_id = s.doc_id and x.k < c.k), -1)),
 b as (select a.doc_id, a.id, a.k as k1, c.k as k2, a.start, a."end" from a left join c1 c on c.doc_id = a.doc_id and a."end" <= c.raw_end and a."end" > coalesce((select max(raw_end) from c1 x where x.doc_id = a.doc_id and x.k < c.k), -1))
 select doc_id, count(*) as n, count(*) filter (k1 is not null and k2 is not null) as mapped, count(*) filter (k1 is null or k2 is null) as missed from b group by 1"""
)
def spans_remapped(spark, d):
    """Names, with the character before, in texts whose lines are chunks: those before a text's first line begin nowhere."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    placed = pages.with_offsets(lines, ["doc_id"], ["k"], "raw", gap=1).where(F.trim("raw") != "").withColumnRenamed("start_off", "raw_start")
    chunks = placed.select("doc_id", "raw_start", (F.col("raw_start") + F.length("raw")).alias("raw_end"), F.col("raw_start").alias("content_start"), (F.col("raw_start") + F.length("raw")).alias("content_end"), F.col("raw_start").alias("out_start"))
    own = _gold(spark, d).select("doc_id", "id", (F.col("start") - 1).alias("start"), "end")
    return pages.remap_counts(own, chunks, ["doc_id"])


@query("with n as (select file_id, series || case file_id % 4 when 0 then '_t1.0_thinklow' when 1 then '_t1.0_thinkhigh_el' when 2 then '_t1.0_el' else '_t1.0_thinklower' end as name from run_files) select file_id, case when file_id % 4 < 2 then replace(name, '_t1.0_', '_t0.1_') else name end as name, case when file_id % 4 < 2 then '0.1' else '1.0' end as temperature, case when file_id % 4 < 2 then '0.0' end as reranker_temp from n")
def runs_salvaged(spark, d):
    k = F.col("file_id") % 4
    name = F.concat("series", F.when(k == 0, "_t1.0_thinklow").when(k == 1, "_t1.0_thinkhigh_el").when(k == 2, "_t1.0_el").otherwise("_t1.0_thinklower"))
    files = table(spark, d, "run_files").select("file_id", name.alias("name"), F.lit('{"temperature": "1.0", "model": "m"}').alias("info"))
    rows = runs.salvaged(files, "1.0", "0.1", {"temperature": 0.1, "reranker_temp": 0.0})
    return rows.select("file_id", "name", F.try_element_at("settings", F.lit("temperature")).alias("temperature"), F.try_element_at("settings", F.lit("reranker_temp")).alias("reranker_temp"))


@query("select p_name as model, t as think, 'zeg iets' as prompt from (select distinct p_name from part), (select unnest([null, 'false', 'low']) as t)")
def models_probed(spark, d):
    return runs.probe_grid(table(spark, d, "part"), (None, "false", "low"), "zeg iets", "p_name")


@query(
    "select sum(l_linenumber) as total, sum(case when l_returnflag = 'A' then l_linenumber else 0 end) as corrected, sum(case when l_returnflag = 'N' then 1 else 0 end) as unmatched, round(avg(case when l_linestatus = 'F' then l_discount end), 6) as confidence, round(avg(l_tax), 6) as fuzzy, sum(l_quantity::bigint) as chars, sum(case when l_linestatus = 'F' then l_quantity::bigint end) as mapped, count(*) filter (l_returnflag = 'R') as no_mapping, 0::bigint as no_gt, round(sum(case when l_returnflag = 'A' then l_linenumber else 0 end) * 100.0 / sum(l_linenumber), 6) as corrected_pct, round(sum(case when l_linestatus = 'F' then l_quantity::bigint end) * 100.0 / sum(l_quantity::bigint), 6) as coverage_pct from lineitem"
)
def corrections_summed(spark, d):
    flag, done = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    rows = table(spark, d, "lineitem").select(
        F.when(flag == "R", "no_mapping").otherwise("mapping_attempted").alias("status"), F.col("l_linenumber").alias("total_lines"), F.when(flag == "A", F.col("l_linenumber")).otherwise(0).alias("corrected_lines"),
        (flag == "N").cast("int").alias("unmatched_lines"), F.when(done, F.col("l_discount")).alias("confidence"), F.col("l_tax").alias("fuzzy_accuracy"), F.col("l_quantity").cast("long").alias("gt_chars_total"),
        F.when(done, F.col("l_quantity").cast("long")).alias("gt_chars_mapped"),
    )
    out = runs.correction_summary(rows)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("confidence", "fuzzy", "corrected_pct", "coverage_pct")})


# Geometry of recognised lines.


def _points_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t\n\x0B\f\r\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+'), lambda t: regexp_matches(t, '^[+-]?[0-9]+(\.[0-9]+)?,[+-]?[0-9]+(\.[0-9]+)?$'))"


@query(
    _LINES_SQL
    + f""", raw as (select rec_id, parent_region_id, region_id, line_id, line_idx, {_points_sql('coords')} as cs, {_points_sql('baseline')} as bs from lines),
 pts as (select *, list_transform(cs, lambda t: string_split(t, ',')[1]::double) as cx, list_transform(cs, lambda t: string_split(t, ',')[2]::double) as cy, list_transform(bs, lambda t: string_split(t, ',')[1]::double) as bx, list_transform(bs, lambda t: string_split(t, ',')[2]::double) as yb from raw),
 ys as (select *, case when len(yb) > 0 then list_median(yb) end as y from pts),
 nb as (select *, lag(y) over w as prev_y, lead(y) over w as next_y from ys window w as (partition by rec_id, parent_region_id, region_id order by y nulls first, line_idx)),
 gaps as (select rec_id, y - lag(y) over (partition by rec_id, parent_region_id, region_id order by y, line_idx) as gap from ys where y is not null), pitch as (select rec_id, coalesce(median(gap) filter (gap > 0), 72.0) as pitch from gaps group by 1),
 box as (select nb.*, coalesce(pitch, 72.0) as pitch, list_min(cx) as x0, list_min(cy) as y0, list_max(cx) as x1, list_max(cy) as y1 from nb left join pitch using (rec_id)),
 lim as (select *, y - 0.5 * pitch as high, y + 0.2 * pitch as deep, greatest(y0, y - 0.5 * pitch, coalesce((y + prev_y) / 2, y0)) as top, least(y1, y + 0.2 * pitch, coalesce((y + next_y) / 2, y1)) as low from box)
 select rec_id, region_id, line_id, round_even(x0, 0) as x0, case when len(cx) = 0 then null when y is null then round_even(y0, 0) when low < top then round_even(high, 0) else round_even(top, 0) end as y0, round_even(x1, 0) as x1,
 case when len(cx) = 0 then null when y is null then round_even(y1, 0) when low < top then round_even(deep, 0) else round_even(low, 0) end as y1, round(case when len(bx) > 1 then degrees(atan2(yb[-1] - yb[1], bx[-1] - bx[1])) else 0 end, 6) as angle,
 array_to_string(list_transform(range(1, len(bx) + 1), lambda i: round_even(bx[i], 0)::bigint || ',' || round_even(yb[i], 0)::bigint), ' ') as baseline from lim"""
)
def line_geometry(spark, d):
    rows = _line_rows(spark, d).withColumn("box", geometry.bbox(geometry.point_list(F.col("coords")))).withColumn("base", geometry.point_list(F.col("baseline")))
    rows = rows.withColumn("y", geometry.median_y(F.col("base")))
    near = geometry.neighbours(rows, ["rec_id", "parent_region_id", "region_id"], "y", "line_idx")
    p = geometry.pitch(rows.where("y is not null"), ["rec_id"], ["parent_region_id", "region_id"], "y", "line_idx").withColumnRenamed("rec_id", "_r")
    joined = near.join(p, F.col("rec_id") == F.col("_r"), "left")
    box = geometry.line_box(F.col("box"), F.col("y"), F.coalesce("pitch", F.lit(geometry.PITCH)), F.col("prev_y"), F.col("next_y"))
    return joined.select("rec_id", "region_id", "line_id", box.alias("b"), F.round(geometry.angle(F.col("base")), 6).alias("angle"), geometry.baseline_text(F.col("base")).alias("baseline")).select("rec_id", "region_id", "line_id", "b.*", "angle", "baseline")
