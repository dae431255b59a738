"""A table of triples: routes, constraint rules, places, serialisation.

triples(s, p, o): a set. Local names are used throughout (``P183``, ``E9``); joins
are equi joins on s or o.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.operators.ordered import with_neighbours
from vellumflow.session import cut

# Properties and classes by their local names.
TYPE, NEXT, PART_OF, CONTAINS = "type", "P183", "P10i", "P10"
EVENT_CLASSES = ("E1", "E2", "E4", "E5", "E7", "E92")
VISITS = ("P7", "P26", "P27", "proximity")
PLACES, OBJECTS = ("E53",), ("E18", "E19", "E20", "E22")


def _objects(t: DataFrame, *properties: str) -> DataFrame:
    return t.where(F.col("p").isin(*properties)).select("s", "o")


def _typed(t: DataFrame, *classes: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select(F.col("s").alias("x")).distinct()


def as_set(*parts: DataFrame) -> DataFrame:
    """Triples of several rules as one set."""
    return reduce(DataFrame.unionByName, parts).distinct()


def event_types(events: DataFrame) -> DataFrame:
    """Triples of the class hierarchy of each event; moves are also E9. events: event, is_move."""
    classes = F.array(*map(F.lit, EVENT_CLASSES))
    return events.select(F.col("event").alias("s"), F.lit(TYPE).alias("p"), F.explode(F.when(F.col("is_move"), F.concat(classes, F.array(F.lit("E9")))).otherwise(classes)).alias("o"))


def ordering(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Triples (event, P183, next) of top-level events in order; falls_within null or ``null`` is top level.

    One key may hold most events: the next one is looked up by ranges of the order,
    whose last column has to be unique.
    """
    top = events.where("falls_within is null or falls_within = 'null'").select(*dict.fromkeys([*keys, *order, "event"]))
    nxt = with_neighbours(top, keys, order, following={"_vf_next": ["event"]})
    return nxt.where("_vf_next is not null").select(F.col("event").alias("s"), F.lit(NEXT).alias("p"), F.col("_vf_next.event").alias("o"))


def via_points(moves: DataFrame, known: DataFrame) -> DataFrame:
    """Sub-moves over via points: event, sub_event (``.VP0001``...), from, to.

    moves: event, moved_from, via (array). A via point that isn't known is skipped
    but keeps its number.
    """
    points = moves.select("event", "moved_from", F.posexplode("via").alias("k", "to"))
    there = points.join(known.select(F.col("mention").alias("to")).distinct(), "to", "left_semi")
    before = Window.partitionBy("event").orderBy("k")
    return there.select("event", F.concat("event", F.lit(".VP"), F.lpad((F.col("k") + 1).cast("string"), 4, "0")).alias("sub_event"), F.coalesce(F.lag("to").over(before), F.col("moved_from")).alias("from"), "to")


def route(t: DataFrame, max_depth: int = 40) -> DataFrame:
    """head, event, depth: the chain of P183 from each event that has a successor and no predecessor.

    A chain goes on only where there is exactly one successor. Each event points to
    the one before it and how far that is; in a round it takes over the pointer of
    the event it points to, so a chain of n events takes log n rounds of one join and
    one checkpoint. Rounds end when all pointers lead to a head, or after as many as
    a chain of all links would take (``max_depth`` at most): what still doesn't is on
    a cycle, which has no head and isn't walked. An event met at several distances
    from one head stands at the smallest.
    """
    links = cut(_objects(t, NEXT).distinct())
    single = links.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o")).where("n = 1").select("s", "o")
    heads = links.select("s").distinct().join(links.select(F.col("o").alias("s")).distinct(), "s", "left_anti")
    first = heads.select(F.col("s").alias("_vf_h"))
    # Pointers of events behind others; an event without one before it is a head or on nothing.
    marked = single.join(first, F.col("s") == F.col("_vf_h"), "left")
    rows = cut(marked.select(F.col("o").alias("event"), F.col("s").alias("back"), F.lit(1).cast("long").alias("depth"), F.col("_vf_h").isNotNull().alias("done")))
    for _ in range(min(max_depth, max(1, math.ceil(math.log2(links.count() + 1)) + 1))):
        open_ = rows.where("not done")
        if open_.isEmpty():
            break
        other = rows.select(F.col("event").alias("_vf_e"), F.col("back").alias("_vf_b"), F.col("depth").alias("_vf_d"), F.col("done").alias("_vf_done"))
        further = open_.join(other, F.col("back") == F.col("_vf_e")).select("event", F.col("_vf_b").alias("back"), (F.col("depth") + F.col("_vf_d")).alias("depth"), F.col("_vf_done").alias("done"))
        rows = cut(rows.where("done").unionByName(further).groupBy("event", "back").agg(F.min("depth").alias("depth"), F.bool_or("done").alias("done")))
    own = heads.select(F.col("s").alias("head"), F.col("s").alias("event"), F.lit(0).cast("long").alias("depth"))
    return own.unionByName(rows.where("done").select(F.col("back").alias("head"), "event", "depth"))


def children(t: DataFrame) -> DataFrame:
    """parent, child by containment, said from either side."""
    down = _objects(t, CONTAINS).select(F.col("s").alias("parent"), F.col("o").alias("child"))
    up = _objects(t, PART_OF).select(F.col("o").alias("parent"), F.col("s").alias("child"))
    return down.unionByName(up).distinct()


def roots(t: DataFrame) -> DataFrame:
    """Parents that are in no chain and nobody's child."""
    tree, chain = children(t), _objects(t, NEXT)
    linked = chain.select(F.col("s").alias("x")).unionByName(chain.select(F.col("o").alias("x")))
    return tree.select(F.col("parent").alias("x")).distinct().join(linked, "x", "left_anti").join(tree.select(F.col("child").alias("x")), "x", "left_anti")


def toponyms(t: DataFrame) -> DataFrame:
    """Places: typed E53, or E18 and none of E19, E20, E22."""
    things = _typed(t, "E18").join(_typed(t, "E19", "E20", "E22"), "x", "left_anti")
    return _typed(t, "E53").unionByName(things).distinct()


def visited(t: DataFrame, properties: tuple[str, ...] = VISITS) -> DataFrame:
    """place, n_events, roles of toponyms that an event leads to, from, or has near."""
    hits = t.where(F.col("p").isin(*properties)).select(F.col("o").alias("x"), "s", "p").join(toponyms(t), "x", "left_semi")
    return hits.groupBy(F.col("x").alias("place")).agg(F.count_distinct("s").alias("n_events"), F.array_join(F.array_sort(F.collect_set("p")), ", ").alias("roles"))


def mentioned_only(t: DataFrame, properties: tuple[str, ...] = VISITS) -> DataFrame:
    """Toponyms that no event visits."""
    return toponyms(t).join(visited(t, properties).select(F.col("place").alias("x")), "x", "left_anti").select(F.col("x").alias("place"))


def mention_places(t: DataFrame) -> DataFrame:
    """mention, place by ``P67i`` citations (targets beginning with CT)."""
    return _objects(t, "P67i").where(F.col("o").startswith("CT")).select(F.col("o").alias("mention"), F.col("s").alias("place")).distinct()


def citations(t: DataFrame, order: DataFrame) -> DataFrame:
    """mention, event: of each cited mention the first event that cites it. order: event, seq."""
    cited = _objects(t, "P129").select(F.col("s").alias("event"), F.col("o").alias("mention")).join(order, "event")
    return cited.groupBy("mention").agg(F.min_by("event", F.struct("seq", "event")).alias("event"))


def kb_links(mentions: DataFrame) -> DataFrame:
    """closeMatch triples; both ids of a mention count. mentions: uri, wd, gn."""
    from vellumflow.functions.ids import kb_id

    wd = mentions.select(F.col("uri").alias("s"), F.lit("closeMatch").alias("p"), kb_id(F.col("wd")).alias("o"))
    gn = mentions.select(F.col("uri").alias("s"), F.lit("closeMatch").alias("p"), kb_id(F.col("gn")).alias("o"))
    return as_set(wd, gn).where("o is not null")


def uris(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions with ``uri_of``: the mention whose URI each one shares.

    mentions: keys, pos (order), wd, gn. The first mention with a Wikidata id fixes
    the URI of that id; then the GeoNames id is asked. A mention found by one id
    does not register its other one, so this is no closure: it depends on order and
    is walked in order, one letter (keys) at a time.
    """
    def walk(pdf):
        pdf = pdf.sort_values("pos")
        seen: dict[tuple, int] = {}
        out = []
        for pos, wd, gn in zip(pdf["pos"], pdf["wd"], pdf["gn"]):
            ids = [(kind, x) for kind, x in (("wd", wd), ("gn", gn)) if isinstance(x, str) and x]
            hit = next((seen[i] for i in ids if i in seen), None)
            if hit is None:
                hit = pos
                for i in ids:
                    seen[i] = pos
            out.append(hit)
        return pdf.assign(uri_of=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mentions.schema.fields) + ", uri_of long"
    return mentions.groupBy(*keys).applyInPandas(walk, schema)


def violations(t: DataFrame) -> DataFrame:
    """rule, severity, subject, object of each breach of the constraint rules; object is '' where a triple is missing.

    One aggregation gives each node its classes and properties, from which all rules
    about a node itself are read at once. Rules about what a property leads from or
    to look at the distinct (property, node) pairs only, so a place that a third of
    all triples lead to is looked up once.
    """
    t = cut(t.distinct())  # read several times
    is_type = F.col("p") == TYPE
    nodes = cut(
        t.groupBy(F.col("s").alias("x")).agg(
            F.collect_set(F.when(is_type, F.col("o"))).alias("classes"), F.collect_set("p").alias("props"), F.bool_or((F.col("p") == "P129") & F.col("o").startswith("TS")).alias("cites_time")
        )
    )

    def of(column: str, *values: str) -> Column:
        return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))

    event, move, letter = of("classes", "E7", "E9"), of("classes", "E9"), of("classes", "F2") & (F.instr("x", ".") == 0)
    journey = F.col("x").endswith(".RS") & (F.regexp_count("x", F.lit(r"\.RS")) == 1)
    sub = move & F.col("x").rlike(r"\.VP\d{4}$")
    row = lambda rule, severity, obj="": F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(obj).alias("object"))
    own = [
        (event & (F.size(F.array_intersect("classes", F.array(*map(F.lit, EVENT_CLASSES)))) < len(EVENT_CLASSES)), row("V1a", "warn")),
        (of("props", NEXT, "P26", "P27", "P7") & ~event, row("V1b", "error")),
        *[(move & ~journey & ~of("props", p), row("V2", "error", p)) for p in ("P26", "P27")],
        (of("classes", "E7") & ~move & ~of("props", "P7", "P8"), row("V3", "warn")),
        (event & ~of("props", "P11"), row("V10", "warn")),
        (event & (~F.col("x").startswith("BRF") | (F.instr("x", "RS") == 0)), row("V11", "warn")),
        (F.col("cites_time") & ~of("props", "P4"), row("V12", "warn")),
        (letter & ~of("props", "P129"), row("V17", "warn")),
        *[(sub & ~of("props", p), row("V19", "error", p)) for p in ("P26", "P27", PART_OF)],
    ]
    found = [nodes.select(F.col("x").alias("subject"), F.inline(F.array_compact(F.array(*[F.when(c, r) for c, r in own])))).select("rule", "severity", "subject", "object")]

    # (rule, severity, properties, classes of which the node needs one, other classes that excuse it)
    targets = [
        ("V4", "error", ("P7", "P26", "P27"), PLACES, ()), ("V5", "warn", ("P8",), OBJECTS, ()), ("V13", "error", ("P4",), ("E52",), ()), ("V14", "error", ("P59",), PLACES, ()), ("V15", "warn", ("P101",), ("E55",), ()),
        ("V16", "warn", ("P16",), ("E22",), ()), ("V18", "warn", ("P12",), (*OBJECTS, "E53", "F2"), ("E74",)), ("V20", "error", ("proximity",), ("E53", "E18"), ()),
    ]
    sources = [("V14", "error", ("P59",), ("E18",), ()), ("V20", "error", ("proximity",), ("E5",), ())]
    for rules, end in ((targets, "o"), (sources, "s")):
        props = sorted({p for _, _, ps, _, _ in rules for p in ps})
        edges = t.where(F.col("p").isin(*props))
        known = nodes.select(F.col("x").alias("_vf_x"), "classes")
        seen = edges.select("p", F.col(end).alias("x")).distinct().join(known, F.col("x") == F.col("_vf_x"), "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
        bad = [F.when(F.col("p").isin(*ps) & ~of("classes", *need, *excuse), F.struct(F.lit(r).alias("rule"), F.lit(sev).alias("severity"))) for r, sev, ps, need, excuse in rules]
        wrong = seen.select(F.col("p").alias("_vf_p"), "x", F.inline(F.array_compact(F.array(*bad))))
        found.append(edges.join(wrong, (F.col("p") == F.col("_vf_p")) & (F.col(end) == F.col("x"))).select("rule", "severity", F.col("s").alias("subject"), F.col("o").alias("object")))

    chain = _objects(t, NEXT)
    starts, ends = chain.select(F.col("s").alias("x")).distinct(), chain.select(F.col("o").alias("x")).distinct()
    for name, one, other in (("first", starts, ends), ("last", ends, starts)):
        n = one.join(other, "x", "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")
        found.append(n.select(F.lit("V6").alias("rule"), F.lit("error").alias("severity"), F.lit(name).alias("subject"), F.col("n").cast("string").alias("object")))
    outside = nodes.where(event & ~journey).select("x").join(starts, "x", "left_anti").join(ends, "x", "left_anti").join(children(t).select(F.col("child").alias("x")), "x", "left_anti")
    found.append(outside.select(F.lit("V6").alias("rule"), F.lit("warn").alias("severity"), F.col("x").alias("subject"), F.lit("").alias("object")))
    told = t.where("p = 'P67'").select(F.col("s").alias("x"), "o").join(nodes.where(letter).select("x"), "x", "left_semi").select(F.col("o").alias("x"))
    both = told.intersect(t.where(F.col("p").isin(*VISITS)).select(F.col("o").alias("x")))
    found.append(both.select(F.lit("V8").alias("rule"), F.lit("error").alias("severity"), F.col("x").alias("subject"), F.lit("").alias("object")))
    return reduce(DataFrame.unionByName, found)


def containment_counts(t: DataFrame) -> DataFrame:
    """root, n_children: what each journey root contains."""
    return children(t).join(roots(t).select(F.col("x").alias("parent")), "parent", "left_semi").groupBy(F.col("parent").alias("root")).agg(F.count(F.lit(1)).alias("n_children"))


def summary(t: DataFrame) -> DataFrame:
    """One row of counts: events, moves, translocations, citations, near places, places told only."""
    t = cut(t.distinct())
    is_type = lambda c: (F.col("p") == TYPE) & (F.col("o") == c)
    counts = t.agg(
        F.count_if(is_type("E7")).alias("n_events"), F.count_if(is_type("E9")).alias("n_moves"), F.count_if(F.col("p") == NEXT).alias("n_links"),
        F.count_if(F.col("p") == "P129").alias("n_citations"), F.count_if(F.col("p") == "proximity").alias("n_near"),
    )
    return counts.crossJoin(mentioned_only(t).agg(F.count(F.lit(1)).alias("n_mentioned_only")))  # one row each


def turtle(t: DataFrame, prefix: str = "ex") -> DataFrame:
    """s, block: each subject's triples as Turtle text, properties and objects in order, so equal graphs give equal bytes."""
    name = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z_][\w]*$"), F.concat(F.lit(f"{prefix}:"), F.col(c))).otherwise(F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    prop = F.when(F.col("p") == TYPE, F.lit("a")).otherwise(F.concat(F.lit(f"{prefix}:"), F.col("p")))
    lines = t.distinct().select("s", prop.alias("p"), name("o").alias("o")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("os"))
    return lines.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "os"))), " ;\n    ").alias("b")).select("s", F.concat(F.lit(f"{prefix}:"), F.col("s"), F.lit(" "), F.col("b"), F.lit(" .")).alias("block"))
