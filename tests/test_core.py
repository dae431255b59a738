"""Core operators on small fixtures, by hand-computed answers and properties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumflow.functions import ids
from vellumflow.functions import text as tx
from vellumflow.operators import align, editions, geometry, graph, linking, metrics, nested, ordered, pages, relations, runs, spans
from vellumflow.session import spread


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def _spans(spark, rows):
    return spark.createDataFrame(rows, "id long, page int, label string, start long, end long")


def test_neighbours_equal_windows_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randint(0, 300), i, rng.choice([None, "x", "y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i long, v string")
    got = ordered.with_neighbours(df, ["k"], ["t", "i"], previous={"p": ["i"]}, following={"n": ["i"]}, last_seen={"s": "v"})
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("*", F.struct(F.lag("i").over(w).alias("i")).alias("p"), F.struct(F.lead("i").over(w).alias("i")).alias("n"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"))
    plain = lambda d: sorted((r.i, r.p and r.p.i, r.n and r.n.i, r.s or "") for r in d.collect())
    assert plain(got) == [(a, b or None, c or None, d) if b != 0 and c != 0 else (a, b, c, d) for a, b, c, d in plain(want)]
    assert ordered.with_neighbours(df.limit(0), ["k"], ["t", "i"], previous={"p": ["i"]}).count() == 0


def test_overlap_scoring_by_scope(spark):
    gold = _spans(spark, [(1, 1, "A", 0, 4), (2, 1, "B", 10, 15), (3, 2, "B", 3, 5)])
    pred = _spans(spark, [(1, 1, "A", 2, 6), (2, 1, "A", 11, 12), (3, 2, "A", 0, 2), (4, 2, "B", 9, 14)])
    (by_page,) = metrics.relaxed(gold, pred, ["page", "label"], []).collect()
    assert (by_page.tp, by_page.fp, by_page.fn) == (1, 3, 2) and by_page.p == 1 / 4 and by_page.r == 1 / 3
    (pooled,) = metrics.relaxed(gold, pred, ["label"], []).collect()
    assert (pooled.tp, pooled.fp, pooled.fn) == (2, 1, 1)
    assert _rows(spans.instances(gold, pred, ["page", "label"]), "type", "id", "r_id") == [("FN", 2, None), ("FN", 3, None), ("FP", None, 2), ("FP", None, 3), ("FP", None, 4), ("TP", 1, 1)]
    (none,) = metrics.relaxed(gold.limit(0), pred.limit(0), ["page", "label"], []).collect()
    assert none.p == 1.0 and none.f1 == 1.0


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: [(i, rng.randint(0, 2), "A", s := rng.randint(0, 3000), s + rng.choice([1, 5, 700, 1500])) for i in range(n)]
    a, b = make(60), make(60)
    got = _rows(spans.overlapping(_spans(spark, a), _spans(spark, b), ["page"], "id", "id"), "id", "r_id")
    want = sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] < y[4] and y[3] < x[4]), key=repr)
    assert got == want
    g, p = spans.matched(_spans(spark, a), _spans(spark, b), ["page"])
    assert {r.id for r in g.where("hit").collect()} == {x for x, _ in want} and g.count() == 60 and p.count() == 60
    assert {r.id for r in p.where("hit").collect()} == {y for _, y in want}


def test_ordered_filters(spark):
    df = _spans(spark, [(i, 1, "A", s, e) for i, (s, e) in enumerate([(0, 10), (0, 5), (2, 8), (6, 12), (11, 12)])])
    assert _rows(spans.not_contained(df, ["page"]), "start", "end") == [(0, 10), (6, 12)]
    fold = lambda rows, how: [(k.start, k.end) for k in spans.greedy(_spans(spark, [(i, 1, "A", s, e) for i, (s, e) in enumerate(rows)]), ["page"], how).first().kept]
    assert fold([(0, 5), (3, 8), (7, 9)], "input") == [(0, 5), (7, 9)]
    assert fold([(0, 3), (2, 9), (8, 10)], "longest") == [(2, 9)]
    rng = random.Random(6)
    rows = [(i, i % 3, "A", s := rng.randint(0, 40), s + rng.randint(1, 9)) for i in range(90)]
    kept = []
    for page in range(3):
        own = []
        for i, p, _, s, e in sorted((x for x in rows if x[1] == page), key=lambda x: (x[3], -x[4], x[0])):
            if not any(s >= a and e <= b for a, b in own):
                own.append((s, e))
        kept += [(page, *x) for x in own]
    assert _rows(spans.not_contained(_spans(spark, rows), ["page"]), "page", "start", "end") == sorted(kept, key=repr)


def test_best_jaccard(spark):
    gold = _spans(spark, [(0, 1, "A", 10, 20)])
    mentions = _spans(spark, [(1, 1, "A", 5, 15), (2, 1, "A", 12, 20), (3, 1, "A", 10, 18), (4, 1, "B", 10, 20)])
    assert _rows(spans.best_jaccard(gold, mentions, ["page", "label"]), "id", "r_id", "jaccard") == [(0, 2, 0.8)]


def test_link_outcomes(spark):
    rows = [("Q1", "Q1"), ("Q1", "Q2"), ("Q1", None), (None, "Q2"), (None, None), ("Q1", "ERROR:x")]
    df = spark.createDataFrame([(g, p, None, "NIL") for g, p in rows], "gold_wd string, pred_wd string, gold_gn string, pred_gn string")
    s = {r.part: (r.tp, r.fp, r.fn) for r in metrics.link_scores(df, [], ("wd", "nil_wd", "nil")).collect()}
    assert s["wd"] == (1, 3, 3) and s["nil_wd"] == (1, 1, 1) and s["nil"] == (1, 1, 1)
    labels = [r.type_combined for r in metrics.link_labels(df).collect()]
    assert labels == ["TP", "FP", "FN", "FP", "TN", "FP"]


def test_macro_is_the_harmonic_mean_of_means(spark):
    df = spark.createDataFrame([("IN", "IN"), ("IN", "NEAR"), ("NEAR", "NEAR"), ("TO", None)], "gold string, pred string").withColumn("x", F.lit(1))
    m = metrics.macro_micro(metrics.fine_grained(df, ["x"], digits=3), ["x"]).first()
    assert abs(m.macro_p - (1 + 0.5 + 0) / 3) < 1e-9 and abs(m.macro_r - (0.5 + 1 + 0) / 3) < 1e-9 and abs(m.micro_f1 - 2 / 4) < 1e-9
    c = {r.gold: r for r in metrics.confusion(df).collect()}
    assert c["IN"]["NEAR"] == 1 and c["TO"]["IN"] == 0 and len(c) == 6


def test_latest_values_by_column(spark):
    df = spark.createDataFrame([(1, 1, 1, 7), (1, 2, 2, None)], "k int, t int, x int, y int")
    assert _rows(runs.latest_values(df, ["k"], "t", ["x", "y"], "t"), "k", "x", "y") == [(1, 2, 7)]
    spread_ = runs.spread(spark.createDataFrame([(1.0, 3.0, 3.0), (1.0, None, 2.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert _rows(spread_, "spread", "best") == [(2.0, "b"), (None, None)]


def test_uris_are_no_closure(spark):
    df = spark.createDataFrame([(1, 0, "Q1", None), (1, 1, "Q1", "G9"), (1, 2, None, "G9"), (1, 3, None, None)], "letter int, pos long, wd string, gn string")
    assert _rows(graph.uris(df, ["letter"]), "pos", "uri_of") == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_routes_end_on_cycles_and_branches(spark):
    links = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("h", "i"), ("i", "j"), ("j", "i"), ("m", "n"), ("m", "o"), ("n", "p")]
    t = spark.createDataFrame([(s, "P183", o) for s, o in links] + [("P", "P10", "a"), ("kid", "P10i", "P")], "s string, p string, o string")
    got = {}
    for r in graph.route(t).collect():
        got.setdefault(r.head, {})[r.depth] = r.event
    assert got["a"] == {0: "a", 1: "b", 2: "c"} and got["h"] == {0: "h", 1: "i", 2: "j"} and got["m"] == {0: "m"} and "d" not in got
    assert _rows(graph.children(t), "parent", "child") == [("P", "a"), ("P", "kid")] and [r.x for r in graph.roots(t).collect()] == ["P"]
    assert graph.route(t.limit(0)).count() == 0


def test_violations_of_each_kind(spark):
    ok = [("BRF.RS.1", "type", c) for c in (*graph.EVENT_CLASSES, "E9")] + [("BRF.RS.1", p, o) for p, o in (("P26", "A"), ("P27", "B"), ("P11", "G"), ("P183", "BRF.RS.2"))]
    ok += [("BRF.RS.2", "type", c) for c in graph.EVENT_CLASSES] + [("BRF.RS.2", "P7", "A"), ("BRF.RS.2", "P11", "G"), ("A", "type", "E53"), ("B", "type", "E53"), ("L", "type", "F2"), ("L", "P129", "x")]
    make = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    assert graph.violations(make(ok)).count() == 0
    bad = ok + [
        ("X1", "type", "E7"), ("X1", "P8", "A"), ("X1", "P4", "A"), ("X1", "P129", "TS1"), ("X2", "P26", "?"), ("B", "P59", "L"), ("B", "P101", "L"), ("B", "P16", "L"), ("B", "P12", "nobody"), ("B", "proximity", "L"), ("L", "P67", "A"),
        ("BRF.RS.1.VP0001", "type", "E9"), ("M", "type", "F2"), ("X3", "type", "E7"), ("X3", "P129", "TS2"),
    ]
    rules = {r.rule for r in graph.violations(make(bad)).collect()}
    assert rules == {f"V{n}" for n in (2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20)} | {"V1a", "V1b"}
    assert graph.violations(make(ok).limit(0)).where("rule <> 'V6'").count() == 0


def test_pages_and_offsets(spark):
    text = "﻿voor[1] een ½\n[2]  \n[16] ü😀 twee[1] weer [XIV] vier"
    df = spark.createDataFrame([("l", text), ("m", None), ("n", "")], "letter_id string, text string")
    got = _rows(pages.by_markers(df), "page", "start_off", "text")
    assert got == [("1", text.index("[1] weer"), "[1] weer [XIV] vier"), ("16", text.index("[16]"), "[16] ü😀 twee")]
    roman = _rows(pages.by_markers(df, pattern=pages.ANY_MARKER, keep_marker=False), "page", "text")
    assert ("XIV", "vier") in roman and ("1", "weer") in roman
    ruled = pages.by_rule(spark.createDataFrame([("l", "﻿ a \n____________________\n \n________________\nbb")], "letter_id string, text string"))
    assert _rows(ruled, "page", "start_off", "text") == [(1, 0, "a"), (2, 1, "bb")]
    p = spark.createDataFrame([("l", "a", 1), ("l", "b", 10)], "k string, page string, start_off long")
    s = spark.createDataFrame([("l", x) for x in (0, 1, 9, 10)], "k string, start long")
    assert _rows(pages.assigned(s, p, ["k"]), "start", "page") == [(1, "a"), (10, "b"), (9, "a")]
    chunks = spark.createDataFrame([("l", 0, 6, 2, 5, 0), ("l", 10, 14, 10, 13, 3)], "k string, raw_start long, raw_end long, content_start long, content_end long, out_start long")
    raw = spark.createDataFrame([("l", 0, 4), ("l", 3, 12), ("l", 7, 9)], "k string, start long, end long")
    assert _rows(pages.remapped(raw, chunks, ["k"]), "start", "new_start", "new_end") == [(0, 0, 2), (3, 1, 5)]
    tokens = pages.tokenized(spark.createDataFrame([(1, "a  b\n😀c"), (2, None)], "doc_id long, text string"), "doc_id")
    assert _rows(tokens, "token", "start", "end") == [("a", 0, 1), ("b", 3, 4), ("😀c", 5, 7)]


def test_text_functions(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c.alias("r")).first().r if v else spark.range(1).select(c.alias("r")).first().r
    assert one(tx.roman(F.lit("XIV"))) == 14 and one(tx.roman(F.lit("xl"))) == 40 and one(tx.roman(F.lit("12"))) is None
    assert one(tx.rerank_scores(F.lit("1: 8.5\n2) 7\n3. 6,5\n4 - 3"), F.lit(5))) == [0.85, 0.7, 0.65, 0.3, 0.0]
    assert one(tx.rerank_scores(F.lit("8\n 4,5 \nja 3"), F.lit(3))) == [0.8, 0.45, 0.0] and one(tx.rerank_scores(F.lit("1: 0\n7\n1: 2"), F.lit(1))) == [0.2] and one(tx.rerank_scores(F.lit(None).cast("string"), F.lit(2))) == [0.0, 0.0]
    c = F.array(F.lit("Q9"), F.lit("456"))
    for answer, wanted in {"Q123 want": "Q123", "gn:456": "gn:456", "NIL": None, "2": "456", "het is 456!": "456", "niets": None, "2 of 3": None, "0": None}.items():
        assert one(tx.selected_id(F.lit(answer), c)) == wanted, answer
    for answer, wanted in {'```json\n{"a": "}"}\n```': '{"a": "}"}', 'proza {"a": {"b": 1}} en {"c": 2}': '{"a": {"b": 1}}', '{"a": 1': None, "niets": None}.items():
        assert one(tx.json_in(F.lit(answer))) == wanted, answer
    assert one(tx.location_terms(F.lit("Utrecht, Europa; de; Den Haag"))) == ["utrecht", "den haag"]
    for mode, wanted in {"de trekschuit": True, "te voet": False, "Postwagens": True, "per schip": False, "trekschuit": False}.items():
        assert one(tx.specific_vehicle(F.lit(mode))) == wanted, mode
    assert one(tx.mode_of(F.lit("reis met de kar met paarden."))) == "paarden" and one(tx.mode_of(F.lit("reis"))) is None
    assert tuple(one(tx.entity_refs(F.lit(None).cast("string"), F.lit("7")))) == ("https://sws.geonames.org/7/", "7")
    assert one(ids.cidoc_type(F.lit("crm/F2_E18"), F.lit("x"), ids.TYPE_BY_ID, ids.TYPE_BY_VALUE)) == "E18_Physical_Thing"
    assert one(ids.cidoc_type(F.lit(""), F.lit("Mode of Transportation"), ids.TYPE_BY_ID, ids.TYPE_BY_VALUE)) == "Mode_of_Transportation"
    assert one(tx.markup(F.lit("ab cd"), F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("P").alias("label"), F.lit("e1").alias("id"))))) == "ab [cd](P, e1)"
    assert one(ids.integral_id(F.lit(" gn:2935704.0"))) == "2935704" and one(ids.kb_id(F.lit("none"))) is None and one(ids.integral_id(F.lit("nan"))) is None
    r = one(ids.ner_run(F.lit("1816_third_letter__gemma4:31b_t0.1_fewshot_dutch")))
    assert (r.source, r.model, r.temperature, r.mode, r.language) == ("1816_third_letter", "gemma4:31b", 0.1, "fewshot", "dutch")
    r = one(ids.linking_run(F.lit("1816_el__gemma4-31b_t0.0_thinkfalse_el")))
    assert (r.source, r.model, r.temperature, r.think) == ("1816_el", "gemma4:31b", 0.0, "false")
    assert one(ids.wikidata_of(F.lit("x wikidata.org/wiki/Q2034601"))) == "Q2034601" and one(ids.geonames_of(F.lit("geonames.org/2856859/"))) == "2856859"
    assert one(ids.scan_number(F.lit("/x/0552_0179_0030.xml"))) == 30


def test_gazetteer_search_finds_what_comparing_every_pair_finds(spark):
    names = ["Utrecht", "Nieuw Utrecht", "Maastricht", "Dordrecht", "Zutphen"]
    gaz = spark.createDataFrame([(i, n, n, None, 1000 * i, "P") for i, n in enumerate(names)], "geonameid long, name string, asciiname string, alternatenames string, population long, feature_class string")
    texts = ["Utrecht", "Utrech", "Zutfen", "xx", "Maastrigt", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mention_key long, text string")
    got = {(r.mention_key, r.name) for r in linking.gazetteer_search(df, gaz).collect()}
    brute = {(i, n) for i, t in enumerate(texts) if t for n in names if max(linking.indel_ratio(t.lower(), n.lower()), linking.partial_ratio(t.lower(), n.lower())) >= 85}
    assert got == brute and got


def test_gazetteer_search_loses_no_pair_above_its_limit(spark):
    rng = random.Random(3)
    names = ["Oder", "tönengrave", "daledoven", "Y", "Ee", "Oer"] + ["".join(rng.choice("abe") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts = ["Frankfurt an der Oder", "Nieuw Stoltengrave", "Altensnachaldoven", "Ypern", "Odr", "Oderr"] + ["".join(rng.choice("abe") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    gaz = spark.createDataFrame([(i, n, n, None, 0, "S") for i, n in enumerate(names)], "geonameid long, name string, asciiname string, alternatenames string, population long, feature_class string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mention_key long, text string")
    got = {(r.mention_key, r.geonameid) for r in linking.gazetteer_search(df, gaz, top=1000).collect()}
    brute = {(i, k) for i, t in enumerate(texts) for k, n in enumerate(names) if max(linking.indel_ratio(t.lower(), n.lower()), linking.partial_ratio(t.lower(), n.lower())) >= 85}
    assert got == brute and {(0, 0), (1, 1), (2, 2), (3, 3)} <= got


def test_gazetteer_search_reads_every_alternate_name(spark):
    gaz = spark.createDataFrame([(1, "Bad Wiler", "Bad Wiler", "Wiler, Karaliere", 0, "S")], "geonameid long, name string, asciiname string, alternatenames string, population long, feature_class string")
    df = spark.createDataFrame([(0, "Roorkaliere")], "mention_key long, text string")
    assert [(r.geonameid, r.score) for r in linking.gazetteer_search(df, gaz).collect()] == [(1, 87.5)]


def test_common_subsequence_equals_the_plain_table():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert linking._common(linking._masks(a), len(a), b) == rows[-1][-1]


def test_linking_pipeline(spark):
    a = spark.createDataFrame([(1, "wd", "Q1", 0), (1, "wd", "Q2", 1), (2, "gn", "77", 0)], "mention_key long, kb string, id string, pos int")
    b = spark.createDataFrame([(1, "wd", "Q2", 0), (1, "wd", "Q3", 1)], "mention_key long, kb string, id string, pos int")
    c = linking.merged_lanes([a, b])
    assert _rows(c, "mention_key", "id", "pos") == [(1, "Q1", 1), (1, "Q2", 2), (1, "Q3", 3), (2, "77", 1)]
    answers = spark.createDataFrame([(1, "wd", "1: 2\n2: 9\n3: 9")], "mention_key long, kb string, answer string")
    top = linking.reranked(c, answers, top=2)
    assert _rows(top, "mention_key", "id", "rank", "rerank_score") == [(1, "Q2", 1, 0.9), (1, "Q3", 2, 0.9), (2, "77", 1, 1.0)]
    said = spark.createDataFrame([(1, "wd", "NIL"), (2, "gn", "1"), (3, "gn", "Q5")], "mention_key long, kb string, answer string")
    assert _rows(linking.selected(top, said), "mention_key", "id") == [(1, None), (2, "77"), (3, None)]


def test_relations(spark):
    body = """{"events": [{"id": "ev1", "type": "move", "moved_from": "e1", "moved_to": "e2", "via_points": ["e3", "e9"], "falls_within": "null",
      "sub_events": ["ev9", {"id": "ev1a", "took_place_at": "e4", "citations": [{"mention_id": "e1", "role": "time"}]}]}, {"id": "ev2", "near_places": ["e2", "e5"]}],
      "toponym_relations": [{"mention_id": "e1", "category": "TO"}, {"mention_id": "e1", "category": "FROM"}, {"mention_id": "e6"}, {"mention_id": "e7", "category": "BY"}]}"""
    df = spark.createDataFrame([(1, body), (2, '{"events": [], "toponym_relations": {"e1": "NO REL"}}'), (3, "geen json"), (4, None)], "doc_id long, body string")
    flat, rel = relations.events(df), relations.toponym_relations(df)
    assert _rows(flat, "doc", "event_id", "parent_id", "depth", "falls_within") == [(1, "ev1", None, 0, None), (1, "ev1a", "ev1", 1, None), (1, "ev2", None, 0, None)]
    assert _rows(rel, "doc", "mention_id", "category") == [(1, "e1", "FROM"), (1, "e7", "BY"), (2, "e1", "NO_REL")]
    mentions = spark.createDataFrame([(1, f"e{k}", k < 7) for k in range(1, 8)], "doc long, mention_id string, is_toponym boolean")
    found = {(r.issue, r.subject) for r in relations.issues(flat, rel, mentions).collect()}
    assert found == {("dangling", "e9"), ("category", "e7"), *{("missing", f"e{k}") for k in (2, 3, 4, 5, 6)}}
    tops = mentions.where("is_toponym").select("doc", "mention_id")
    assert dict(_rows(relations.predictions(flat, rel, tops), "mention_id", "category")) == {"e1": "FROM", "e2": "TO", "e3": "THRU", "e4": "NO_REL", "e5": "NEAR", "e6": "NO_REL"}
    assert dict(_rows(relations.predictions(flat, rel, tops, top_only=False), "mention_id", "category"))["e4"] == "IN"
    roles = {r.mention_id: (r.roles, r.events) for r in relations.role_map(flat).where("doc = 1").collect()}
    assert roles["e2"] == (["moved_to", "near_places"], ["ev1", "ev2"])


def test_tiles_never_overlap_and_hold_the_text(spark):
    text = "Wij reden naar Utrecht en aten daar. Wij reden naar huis, moe maar heel blij."
    lines = ["Wij reden naar", "Wij reden naar", "utrecht  en aten", "huis moe maar heel blijd", "", None, "iets heel anders dan dit"]
    got = align.tile(text, lines)
    assert [g and g[2] for g in got] == ["exact", "exact", "plain words", "similar", None, None, None]
    placed = sorted(g[:2] for g in got if g)
    assert all(b[0] >= a[1] for a, b in zip(placed, placed[1:])) and got[0][:2] == (0, 14) and text[got[2][0] : got[2][1]] == "Utrecht en aten"
    df = spark.createDataFrame([(1, text, lines), (2, None, None)], "key long, text string, lines array<string>")
    rows = align.tiled(df)
    assert rows.count() == len(lines) and rows.where("how = 'none'").count() == 3
    a = align.agreement(rows, ["key"]).first()
    assert a.n_lines == 7 and a.n_placed == 4


def test_editions_lose_nothing(spark):
    text = 'Een "brief" [12] aan <N.> & co.\n[illustratie van X] slot'
    letters = spark.createDataFrame([(1, text), (2, "zonder"), (3, None)], "doc_id long, text string")
    ents = spark.createDataFrame([(1, 21, 25, "E53_Place", "Q1", 'k"1'), (1, 4, 11, "X", None, None)], "doc_id long, start long, end long, label string, ref string, ent_key string")
    tei = editions.tei(letters, ents)
    xml = tei.where("doc_id = 1").first().xml
    assert '<pb n="12"/>' in xml and '<note type="editorial">illustratie van X</note>' in xml and '<placeName ref="Q1" key="k&quot;1">&lt;N.&gt;</placeName>' in xml
    assert {r.lossless for r in editions.check_loss(letters, tei).collect()} == {True}
    words = spark.createDataFrame([(1, "b", 0, "l", 0, 1, "x<", 5.0, 1.0, 2.0, 3.0, "ne_e1"), (1, "b", 0, "l", 0, 0, "a", 1.0, 1.0, 2.0, 3.0, None)], "page long, block_id string, block_seq int, line_id string, line_seq int, word_seq int, text string, x double, y double, w double, h double, tagrefs string")
    alto = editions.alto_pages(words, ["page"]).first().xml
    assert alto.index('CONTENT="a"') < alto.index('CONTENT="x&lt;"') and 'TAGREFS="ne_e1"' in alto and alto.count("<SP/>") == 1


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    p = geometry.point_list(F.lit(" 0,10 10,20.5  ? 20,20 ,7"))
    assert one(F.size(p)) == 3 and one(geometry.median_y(p)) == 20.0 and tuple(one(geometry.bbox(p))) == (0.0, 10.0, 20.0, 20.5)
    assert one(geometry.y_at(p, F.lit(5.0))) == 15.25 and one(geometry.y_at(p, F.lit(-5.0))) == 10.0 and one(geometry.y_at(p, F.lit(99.0))) == 20.0
    empty = geometry.point_list(F.lit(None).cast("string"))
    assert one(geometry.bbox(empty)) is None and one(geometry.median_y(empty)) is None and one(geometry.angle(empty)) == 0.0


def test_nested_points_with_all_kinds_of_gaps(spark):
    line = "struct<line_id:string,custom:string,coords:struct<points:string>,baseline:struct<points:string>,text_equiv:array<struct<conf:double,plain_text:string,unicode_text:string>>>"
    schema = f"rec_id long, reading_order array<struct<idx:int,region_ref:string>>, regions array<struct<region_id:string,custom:string,coords:struct<points:string>,text_lines:array<{line}>,sub_regions:array<struct<region_id:string,custom:string,coords:struct<points:string>,text_lines:array<{line}>>>>>, x string, child string"
    rows = [
        (1, [(1, "b"), None], [("a", "readingOrder {index:3;}", ("1,2 x -3,4.5 5;6",), [("l1", None, None, ("7,8",), None), None, ("l2", None, ("",), None, [])], [("s", None, ("9,9\n1,1",), None), None]), None, ("b", None, None, None, None)], "e", "c"),
        (2, None, None, "e", "c"), (3, [], [], "e", "c"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = _rows(nested.points(df), "parent_region_id", "region_id", "line_id", "child", "point_no", "x")
    assert got == [("", "a", "", "coords", 0, 1.0), ("", "a", "", "coords", 1, -3.0), ("", "a", "l1", "baseline", 0, 7.0), ("a", "s", "", "coords", 0, 9.0), ("a", "s", "", "coords", 1, 1.0)]
    assert _rows(nested.regions(df), "region_id", "is_sub", "reading_idx", "n_lines") == [("a", False, 3, 2), ("b", False, 1, 0), ("s", True, None, 0)]
    assert _rows(nested.lines(df), "line_id", "text") == [("l1", None), ("l2", None)]
    assert nested.points(df.limit(0)).count() == 0


def test_spread_keeps_rows(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df, "id").rdd.getNumPartitions() >= 4 and spread(df, "id").count() == 100


def test_page_labels_sort_by_each_convention(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "XIV", "2", "IX", "los", None)], "page string")
    order = lambda how: [r.page for r in df.orderBy(tx.page_sort(F.col("page"), how), "page").collect()]
    assert [x for x in order("tuple") if x] == ["2", "10", "IX", "XIV", "los"]
    assert [x for x in order("lookup") if x] == ["IX", "XIV", "2", "10", "los"]
    assert [r.n for r in df.orderBy("page").select(tx.page_sort(F.col("page"), "int").alias("n")).where("n is not null").collect()] == [10, 2]


def test_via_points_keep_their_numbers(spark):
    moves = spark.createDataFrame([("E", "a", ["x", "?", "y"]), ("F", "b", [])], "event string, moved_from string, via array<string>")
    known = spark.createDataFrame([("x",), ("y",)], "mention string")
    assert _rows(graph.via_points(moves, known), "sub_event", "from", "to") == [("E.VP0001", "a", "x"), ("E.VP0003", "x", "y")]


def test_ordering_leaves_sub_events_out(spark):
    df = spark.createDataFrame([("l", 1, "a", None), ("l", 2, "b", "a"), ("l", 3, "c", "null"), ("m", 1, "d", None)], "letter string, seq int, event string, falls_within string")
    assert _rows(graph.ordering(df, ["letter"], ["seq"]), "s", "p", "o") == [("a", "P183", "c")]


def test_pitch_and_boxes(spark):
    df = spark.createDataFrame([(1, "r", 10.0, 1), (1, "r", 30.0, 2), (1, "s", 5.0, 1), (1, "s", 45.0, 2), (2, "r", 7.0, 1)], "page int, region string, y double, i int")
    assert _rows(geometry.pitch(df, ["page"], ["region"], "y", "i"), "page", "pitch") == [(1, 30.0), (2, 72.0)]
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(50.0).alias("y1"))
    one = lambda base, prev: tuple(spark.range(1).select(geometry.line_box(box, base, F.lit(20.0), prev, F.lit(None).cast("double")).alias("b")).first().b)
    assert one(F.lit(30.0), F.lit(None).cast("double")) == (0.0, 20.0, 9.0, 34.0)
    assert one(F.lit(30.0), F.lit(18.0)) == (0.0, 24.0, 9.0, 34.0)
    assert one(F.lit(30.0), F.lit(90.0)) == (0.0, 20.0, 9.0, 34.0)  # crossing baselines
    assert one(F.lit(None).cast("double"), F.lit(10.0)) == (0.0, 0.0, 9.0, 50.0)


def test_completion_consensus_and_statuses(spark):
    grid = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "model string, cell string")
    done = spark.createDataFrame([("m", "a"), ("m", "a")], "model string, cell string")
    assert _rows(runs.completion(grid, done, ["model", "cell"], "model", "cell"), "model", "n_done", "n_cells", "missing") == [("m", 1, 2, "b"), ("n", 0, 1, "a")]
    assert _rows(runs.pending(grid, done, ["model", "cell"]), "model", "cell") == [("m", "b"), ("n", "a")]
    errors = spark.createDataFrame([(None, "m1"), (None, "m2"), (None, "m2"), ("x", "m1")], "text string, model string")
    assert _rows(runs.consensus(errors, ["text"], "model", 4), "text", "n_models", "n_runs", "models", "miss_rate") == [("x", 1, 1, "m1", 0.25), (None, 2, 3, "m1, m2", 0.5)]
    scans = spark.createDataFrame([(1,), (2,), (3,)], "scan int")
    mapping = spark.createDataFrame([(1, "I"), (2, "II")], "scan int, page string")
    truth = spark.createDataFrame([("I", "tekst"), ("II", " ")], "page string, text string")
    assert _rows(align.correction_status(scans, mapping, truth), "scan", "status") == [(1, "mapping_attempted"), (2, "no_gt"), (3, "no_mapping")]
