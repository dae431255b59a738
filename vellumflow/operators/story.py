"""The events of a letter as a graph, and the graph read back as a route.

Each rule gives triples of its own, by equi joins of events, roles and mentions; the
graph is the set of all. Names are local (``P183``, ``E9``); ``conveys`` leads from an
event to its citations (``CT.<letter>.<mention>``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions.ids import event_uri, kb_id, mapped
from vellumflow.functions.text import event_kind, mode_of, specific_vehicle
from vellumflow.operators.graph import CONTAINS, NEXT, PART_OF, TYPE, as_set, children, event_types, kb_links, mentioned_only, ordering, route, uris, via_points
from vellumflow.operators.relations import roles
from vellumflow.session import cut

#: Of each kind of entity the prefix of its URI, its classes, the length its text is cut at, and whether an id follows it.
KINDS = {
    "E53_Place": ("LOC", ("E1", "E53"), 30, True),
    "E18_Physical_Thing": ("LOC", ("E1", "E18", "E53"), 30, True),
    "vehicle": ("VEH", ("E1", "E18", "E22"), 30, True),
    "mode": ("MOD", ("E1", "E55", "Mode_of_Transportation"), 30, False),
    "E52_Time_Span": ("TS", ("E52",), 40, False),
    "F2_Expression": ("ART", ("F2",), 40, False),
    "E19_Physical_Object": ("PHO", ("E1", "E18", "E19"), 30, True),
    "E20_Biological_Object": ("BIO", ("E1", "E18", "E19", "E20"), 30, True),
    "E31_Document": ("DOC", ("E1", "E73", "E31"), 30, True),
}
#: Property that each role of an event stands for, for moves and for stays.
MOVE_ROLES = {"moved_from": "P27", "moved_to": "P26", "near_places": "proximity", "viewed_artifacts": "P12"}
STAY_ROLES = {"took_place_at": "P7", "on_or_within": "P8", "near_places": "proximity", "viewed_artifacts": "P12"}


def entities(mentions: DataFrame) -> DataFrame:
    """doc, mention_id, text, label, kind, wd, gn, uri: what each mention stands for.

    mentions: doc, mention_id, pos, text, label, wd, gn. Labels that are none of the
    known ones are places. Places that share an id share the URI of the first of
    them in text order (``graph.uris``).
    """
    kind = F.when(F.col("label") == "Mode_of_Transportation", F.when(specific_vehicle(F.col("text")), "vehicle").otherwise("mode")).otherwise(
        F.when(F.col("label").isin(*KINDS), F.col("label")).otherwise("E53_Place")
    )
    of = lambda k, t: mapped(F.col("kind"), {name: str(v[k]) for name, v in KINDS.items()}).cast(t)
    plain = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9]", "_")
    rows = mentions.select("doc", "mention_id", "pos", "text", "label", kind.alias("kind"), kb_id(F.col("wd")).alias("wd"), kb_id(F.col("gn")).alias("gn"))
    kb = F.left(plain(F.coalesce("wd", "gn")), F.lit(20))
    own = F.concat(of(0, "string"), F.lit("."), F.left(plain(F.col("text")), of(2, "int")), F.when(of(3, "boolean") & kb.isNotNull(), F.concat(F.lit("_"), kb)).otherwise(F.lit("")))
    rows = rows.withColumn("own", own)
    places = F.col("kind").isin("E53_Place", "E18_Physical_Thing")
    shared = uris(rows.where(places).select("doc", F.col("pos").cast("long").alias("pos"), "wd", "gn"), ["doc"]).select(F.col("doc").alias("_vf_d"), F.col("pos").alias("_vf_p"), "uri_of")
    firsts = rows.select(F.col("doc").alias("_vf_e"), F.col("pos").cast("long").alias("_vf_q"), F.col("own").alias("first"))
    joined = rows.join(shared, (F.col("doc") == F.col("_vf_d")) & (F.col("pos") == F.col("_vf_p")), "left").join(firsts, (F.col("doc") == F.col("_vf_e")) & (F.col("uri_of") == F.col("_vf_q")), "left")
    return joined.select("doc", "mention_id", "pos", "text", "label", "kind", "wd", "gn", F.coalesce("first", "own").alias("uri"))


def _t(s: Column, p: str | Column, o: Column) -> Column:
    return F.struct(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"))


def _emit(rows: DataFrame, *triples: Column) -> DataFrame:
    """Triples of each row; those with a null part are left out."""
    return rows.select(F.inline(F.filter(F.array(*triples), lambda t: t["s"].isNotNull() & t["p"].isNotNull() & t["o"].isNotNull())))


def _classes(s: Column, names: tuple[str, ...]) -> list[Column]:
    return [_t(s, TYPE, F.lit(c)) for c in names]


def triples(flat: DataFrame, mentions: DataFrame, group: str = "TG") -> DataFrame:
    """The graph (s, p, o) of letters: the letter, its journey, events, their order, places, via points, citations, and what is only told of.

    flat: ``relations.events``; mentions: as ``entities`` takes them. A role that
    refers to no mention gives nothing. An entity has the classes of its label,
    whatever role names it. The first event that cites a mention conveys it; one
    that no event cites is conveyed by the journey and referred to by the letter.
    """
    known = cut(entities(mentions))
    flat = cut(flat.where("event_id is not null").withColumn("event", event_uri("", F.col("doc"), F.col("event_id"))))
    letters = flat.select("doc").unionByName(known.select("doc")).distinct()
    journey = F.concat("doc", F.lit(".RS"))
    tg = F.lit(group)
    head = _emit(
        letters, _t(F.col("doc"), TYPE, F.lit("F2")), _t(F.col("doc"), "P129", journey), _t(journey, "P129i", F.col("doc")), _t(journey, "P67i", F.col("doc")), _t(journey, "P11", tg), _t(journey, "P12", tg), _t(tg, TYPE, F.lit("E74"))
    )

    is_move = F.coalesce(F.col("type"), F.lit("translocation")) == "translocation"
    moved = flat.withColumn("is_move", is_move)
    parent = F.when(F.col("parent_id").isNotNull(), event_uri("", F.col("doc"), F.col("parent_id")))
    within = F.when(F.col("falls_within").isNotNull(), event_uri("", F.col("doc"), F.col("falls_within")))
    whole = F.coalesce(within, parent, journey)
    own = _emit(
        moved, _t(F.col("event"), "label", F.coalesce("label", F.lit(""))), _t(F.col("event"), "P11", tg), _t(F.col("event"), "P12", tg), _t(F.col("event"), PART_OF, whole), _t(whole, CONTAINS, F.col("event")),
        _t(F.col("event"), "P132", journey), _t(F.col("event"), "P132", parent),
    )
    chain = ordering(moved, ["doc"], ["seq", "event"])
    also = chain.select("s", F.lit("P182").alias("p"), "o")

    used = roles(flat).join(moved.select("doc", F.col("seq").alias("_vf_s"), "event", "is_move", F.col("type").alias("_vf_type")), ["doc"]).where("seq = _vf_s")
    used = cut(used.drop("pos").join(known, ["doc", "mention_id"]).select("doc", "event", "seq", "pos", "is_move", "role", "mention_id", "uri", "kind", "label", "text"))
    role = F.col("role")
    prop = F.coalesce(
        F.when(F.col("is_move"), mapped(role, MOVE_ROLES)).otherwise(mapped(role, STAY_ROLES)),
        F.when((role == "citation:mode_of_transportation") & (F.col("kind") == "vehicle"), "P16").when((role == "citation:mode_of_transportation") & (F.col("kind") == "mode"), "P101"),
        F.when(role.isin("citation:time_span", "time_span") & (F.col("label") == "E52_Time_Span"), "P4"),
        F.when((role == "mentions_places") & (F.col("label") == "F2_Expression"), "P12"),
    )
    told = role.isin("viewed_artifacts", "mentions_places") | (role == "via_points") & ~F.col("is_move")
    parts = _emit(used, _t(F.col("event"), prop, F.col("uri")), _t(F.when(told, F.col("doc")), "P67", F.col("uri")))

    moves = used.where("role = 'moved_from'").groupBy("doc", "event").agg(F.min("mention_id").alias("_vf_from"))
    via = flat.where(is_move).select("doc", "event", F.try_variant_get("v", "$.via_points", "array<string>").alias("via")).where(F.size("via") > 0)
    via = via.join(moves.select(F.col("doc").alias("_vf_d"), F.col("event").alias("_vf_e"), "_vf_from"), (F.col("doc") == F.col("_vf_d")) & (F.col("event") == F.col("_vf_e")), "left")
    keyed = lambda c: F.concat_ws("\t", F.col("doc"), c)
    subs = via_points(via.select("event", F.when(F.col("_vf_from").isNotNull(), keyed(F.col("_vf_from"))).alias("moved_from"), F.transform("via", lambda m: F.concat_ws("\t", F.col("doc"), m)).alias("via")), known.select(keyed(F.col("mention_id")).alias("mention")))
    places = known.select(keyed(F.col("mention_id")).alias("_vf_m"), "uri", "text")
    subs = subs.join(places.withColumnsRenamed({"_vf_m": "_vf_to", "uri": "to_uri", "text": "to_text"}), F.col("to") == F.col("_vf_to")).join(places.drop("text").withColumnsRenamed({"_vf_m": "_vf_fr", "uri": "from_uri"}), F.col("from") == F.col("_vf_fr"), "left")
    subs = cut(subs)
    sub = F.col("sub_event")
    passing = _emit(
        subs, _t(sub, "label", F.concat(F.lit("Pass through "), "to_text")), _t(sub, PART_OF, F.col("event")), _t(F.col("event"), CONTAINS, sub), _t(sub, "P11", tg), _t(sub, "P12", tg), _t(sub, "P132", F.col("event")),
        _t(sub, "P27", F.col("from_uri")), _t(sub, "P26", F.col("to_uri")),
    )

    # Citations: what an event says of a mention, in the order of the document; via points are cited by their own move.
    says = used.where(
        role.startswith("citation:") | role.isin("near_places") | F.col("is_move") & role.isin("moved_from", "moved_to") | ~F.col("is_move") & role.isin("took_place_at", "on_or_within")
    ).select("doc", "mention_id", "event", "seq")
    by_via = subs.select(F.substring_index("to", "\t", 1).alias("doc"), F.substring_index("to", "\t", -1).alias("mention_id"), sub.alias("event"), F.lit("~").alias("seq"))
    first = says.unionByName(by_via).groupBy("doc", "mention_id").agg(F.min_by("event", F.struct("seq", "event")).alias("event"))
    touched = used.where(prop.isNotNull() | told).select("doc", "mention_id").unionByName(first.select("doc", "mention_id")).distinct()
    rest = known.join(touched, ["doc", "mention_id"], "left_anti")
    cited = first.join(known, ["doc", "mention_id"]).select("doc", "mention_id", "event", "text", "label", "uri").unionByName(rest.select("doc", "mention_id", journey.alias("event"), "text", "label", "uri"))
    ct = F.concat(F.lit("CT."), "doc", F.lit("."), "mention_id")
    citing = _emit(
        cited, _t(ct, TYPE, F.lit("F2")), _t(ct, "label", F.concat(F.lit("Citation: '"), "text", F.lit("' ("), "label", F.lit(")"))), _t(ct, "P67", F.col("uri")), _t(F.col("uri"), "P67i", ct), _t(F.col("event"), "conveys", ct)
    )
    only_told = _emit(rest, _t(F.col("doc"), "P67", F.col("uri")))

    # Of several mentions of one entity the first gives its name; all give classes and links.
    named = known.groupBy("uri").agg(F.min_by("text", F.struct("doc", "pos")).alias("text"))
    classes = F.transform(F.split(mapped(F.col("kind"), {k: " ".join(v[1]) for k, v in KINDS.items()}), " "), lambda c: _t(F.col("uri"), TYPE, c))
    made = known.select(F.inline(classes)).unionByName(_emit(named, _t(F.col("uri"), "label", F.col("text")))).unionByName(kb_links(known.where("kind not in ('mode', 'E52_Time_Span', 'F2_Expression')").select("uri", "wd", "gn")))
    all_events = moved.select("event", "is_move").unionByName(letters.select(journey.alias("event"), F.lit(True).alias("is_move"))).unionByName(subs.select(sub.alias("event"), F.lit(True).alias("is_move")))
    return as_set(head, own, chain, also, event_types(all_events), parts, passing, citing, only_told, made)


def sections(rooms: DataFrame, known: DataFrame) -> DataFrame:
    """Triples of rooms in buildings (P59, P59i); a pair that comes out as one entity gives none. rooms: doc, room, building (mention ids)."""
    one = known.select("doc", F.col("mention_id").alias("room"), F.col("uri").alias("room_uri"))
    other = known.select("doc", F.col("mention_id").alias("building"), F.col("uri").alias("building_uri"))
    pairs = rooms.join(one, ["doc", "room"]).join(other, ["doc", "building"]).where("room_uri <> building_uri")
    return _emit(pairs, _t(F.col("building_uri"), "P59", F.col("room_uri")), _t(F.col("room_uri"), "P59i", F.col("building_uri"))).distinct()


def _labels(t: DataFrame) -> DataFrame:
    return t.where("p = 'label'").groupBy(F.col("s").alias("x")).agg(F.min("o").alias("label"))


def _qids(t: DataFrame) -> DataFrame:
    return t.where("p = 'closeMatch'").groupBy(F.col("s").alias("x")).agg(F.min("o").alias("qid"))


def attributes(t: DataFrame) -> DataFrame:
    """event, citations, mode, time_spans: what events carry.

    citations: array<struct<ct,mention_id,label,qid>> in order of the citation, qid by
    the entity it refers to; mode: the label of the first general use, empty without
    one; time_spans: labels in order.
    """
    labels, qids = _labels(t), _qids(t)
    said = t.where("p = 'conveys'").select(F.col("s").alias("event"), F.col("o").alias("ct"))
    refers = t.where(F.col("p") == "P67").select(F.col("s").alias("ct"), F.col("o").alias("x")).join(qids, "x", "left").groupBy("ct").agg(F.max("qid").alias("qid"))
    cited = said.join(refers, "ct", "left").join(labels.withColumnsRenamed({"x": "ct", "label": "ct_label"}), "ct", "left")
    one = F.struct("ct", F.substring_index("ct", ".", -1).alias("mention_id"), F.coalesce("ct_label", F.regexp_extract("ct", r"([^/#]*)$", 1)).alias("label"), "qid")
    cited = cited.groupBy("event").agg(F.array_sort(F.collect_list(one)).alias("citations"))
    used = t.where("p in ('P101', 'P4')").select(F.col("s").alias("_vf_e"), "p", F.col("o").alias("x")).join(labels, "x")
    used = used.groupBy("_vf_e").agg(F.min_by(F.when(F.col("p") == "P101", F.col("label")), F.when(F.col("p") == "P101", F.col("x"))).alias("mode"), F.array_sort(F.collect_list(F.when(F.col("p") == "P4", F.col("label")))).alias("time_spans"))
    both = cited.join(used, F.col("event") == F.col("_vf_e"), "full")
    none = F.array().cast("array<string>")
    return both.select(F.coalesce("event", "_vf_e").alias("event"), F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)).alias("citations"), F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("time_spans", none).alias("time_spans"))


def report(t: DataFrame) -> DataFrame:
    """The route of each letter as rows of one form: head, step, event_id, parent_id, type, label, from, from_qid, to, to_qid, at, at_qid, within, within_qid, near, near_qid, mode, citations.

    Events of the chain in order, those that fall within another event of it below
    that one with its step; places that are only told of come last, without head and
    step. Several near places are joined by ``; ``.
    """
    t = cut(t.distinct())
    labels, qids = _labels(t), _qids(t)
    chain = route(t).select("head", "event", "depth")
    tree = children(t).where(~F.col("parent").rlike(r"\.RS$"))
    below = tree.join(chain.select(F.col("event").alias("parent"), "head"), "parent").select(F.col("child").alias("event"), "parent", "head")
    top = chain.join(below.select("event").distinct(), "event", "left_anti")
    top = top.withColumn("step", F.row_number().over(Window.partitionBy("head").orderBy("depth")))
    under = below.join(top.select(F.col("event").alias("parent"), "step"), "parent")
    rows = top.select("head", "step", "event", F.lit(None).cast("string").alias("parent")).unionByName(under.select("head", "step", "event", "parent"))

    places = t.where("p in ('P27', 'P26', 'P7', 'P8', 'proximity')").select(F.col("s").alias("_vf_e"), "p", F.col("o").alias("x")).join(labels, "x", "left").join(qids, "x", "left")
    of = lambda p, c: F.min_by(F.when(F.col("p") == p, F.coalesce(c, F.lit(""))), F.when(F.col("p") == p, F.col("x")))
    near = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("p") == "proximity") & F.col(c).isNotNull(), F.struct("x", c)))), lambda v: v[c]), "; ")
    place = places.groupBy("_vf_e").agg(
        *[of(p, c).alias(f"{n}{s}") for n, p in (("from", "P27"), ("to", "P26"), ("at", "P7"), ("within", "P8")) for c, s in (("label", ""), ("qid", "_qid"))], near("label").alias("near"), near("qid").alias("near_qid")
    )
    moves = t.where((F.col("p") == TYPE) & (F.col("o") == "E9")).select(F.col("s").alias("_vf_m")).distinct()
    said = attributes(t).select(F.col("event").alias("_vf_a"), F.array_join(F.transform("citations", lambda c: c["mention_id"]), "; ").alias("citations"))
    full = rows.join(place, F.col("event") == F.col("_vf_e"), "left").join(moves, F.col("event") == F.col("_vf_m"), "left").join(labels.withColumnRenamed("x", "_vf_l"), F.col("event") == F.col("_vf_l"), "left").join(said, F.col("event") == F.col("_vf_a"), "left")
    is_move, inside = F.col("_vf_m").isNotNull(), F.col("within")
    kind = F.when(F.col("parent").isNull(), event_kind(is_move, inside)).when(inside.isNotNull(), "sub_indoor").otherwise("sub_outdoor/stay")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    names = ["from", "from_qid", "to", "to_qid", "at", "at_qid", "within", "within_qid", "near", "near_qid"]
    out = full.select("head", "step", F.col("event").alias("event_id"), F.coalesce("parent", F.lit("")).alias("parent_id"), kind.alias("type"), blank("label"), *map(blank, names), F.coalesce(F.when(is_move, mode_of(F.col("label"))), F.lit("")).alias("mode"), blank("citations"))
    told = mentioned_only(t).withColumnRenamed("place", "x").join(labels, "x", "left").join(qids, "x", "left")
    empty = {c: F.lit("") for c in names if c != "at_qid"}
    told = told.select(F.lit(None).cast("string").alias("head"), F.lit(None).cast("int").alias("step"), F.lit("").alias("event_id"), F.lit("").alias("parent_id"), F.lit("mentioned_only").alias("type"), F.coalesce("label", "x").alias("label"), *[F.coalesce("qid", F.lit("")).alias(c) if c == "at_qid" else empty[c].alias(c) for c in names], F.lit("").alias("mode"), F.lit("").alias("citations"))
    return out.unionByName(told)


def counts(t: DataFrame) -> DataFrame:
    """n_top, n_sub, translocations, tours, citations, near, mentioned_only: the closing counts of a route, over all letters of the graph."""
    t = cut(t.distinct())
    links = t.where(F.col("p") == NEXT)
    chain = links.select(F.col("s").alias("x")).unionByName(links.select(F.col("o").alias("x"))).distinct()
    moves = t.where((F.col("p") == TYPE) & (F.col("o") == "E9")).select(F.col("s").alias("_vf_m")).distinct()
    below = children(t).join(chain.select(F.col("x").alias("parent")), "parent", "left_semi").select(F.col("child").alias("_vf_c")).distinct()
    rows = chain.join(moves, F.col("x") == F.col("_vf_m"), "left").join(below, F.col("x") == F.col("_vf_c"), "left")
    of_chain = rows.agg(F.count_if(F.col("_vf_c").isNull()).alias("n_top"), F.count_if(F.col("_vf_m").isNotNull()).alias("translocations"), F.count_if(F.col("_vf_m").isNull()).alias("tours"))
    of_graph = t.agg(F.count_if((F.col("p") == TYPE) & (F.col("o") == "F2") & F.col("s").startswith("CT.")).alias("citations"), F.count_if(F.col("p") == "proximity").alias("near"))
    subs = below.agg(F.count(F.lit(1)).alias("n_sub"))
    told = mentioned_only(t).agg(F.count(F.lit(1)).alias("mentioned_only"))
    return of_chain.crossJoin(of_graph).crossJoin(subs).crossJoin(told).select("n_top", "n_sub", "translocations", "tours", "citations", "near", "mentioned_only")  # one row each
