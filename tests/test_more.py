"""Nulls, empty tables, repeated rows and clashing names for look-ups, linking levels, stories, gold tables and runs."""

import random
import types

import pytest
from pyspark.sql import functions as F

from vellumflow import external, session
from vellumflow.operators import align, gold, graph, lookups, metrics, pages, runs, story


def test_linking_counts_at_two_levels(spark):
    columns = "page int, label string, id long, start long, end long, wd string, gn string"
    g = spark.createDataFrame([(1, "P", 1, 0, 5, "Q1", None), (1, "P", 2, 3, 9, "Q2", "gn:7"), (1, "P", 3, 20, 25, "NIL", None), (2, "P", 4, 0, 5, "Q4", None), (3, "P", 5, 0, 3, None, None), (1, None, 6, 0, 5, "Q9", None)], columns)
    p = spark.createDataFrame([(1, "P", 11, 4, 8, "Q1", "7"), (1, "P", 12, 4, 9, "Q2", None), (1, "X", 13, 20, 25, "Q5", None), (3, "P", 14, 0, 3, "ERROR:m wd failed", None)], columns)
    rows = {(r.kb, r.id, r.r_id) for r in metrics.link_pairs(g, p, ["page", "label"]).collect()}
    # Both gold spans of page 1 take the first prediction, so the second one is no gold span's own.
    assert rows == {("match", 1, 11), ("match", 2, 11), ("unmatched_gold", 3, None), ("unmatched_gold", 4, None), ("match", 5, 14), ("unmatched_gold", 6, None), ("unmatched_pred", None, 12), ("unmatched_pred", None, 13)}
    scores = {(r.level, r.part): (r.tp, r.fp, r.fn) for r in metrics.full_link_scores(metrics.link_pairs(g, p, ["page", "label"]), []).collect()}
    assert scores["el", "wd"] == (1, 2, 1) and scores["full", "wd"] == (1, 4, 3) and scores["full", "combined"] == (2, 3, 2)
    assert scores["el", "nil"] == (0, 0, 1) and ("full", "nil") not in scores
    assert metrics.link_pairs(g.limit(0), p.limit(0), ["page", "label"]).count() == 0


def test_look_ups_keep_every_row(spark):
    s = spark.createDataFrame([(1, 0, 5, "Cassel"), (1, 0, 5, "Cassel"), (1, 0, 5, None), (None, 0, 5, "Cassel"), (2, 0, 5, "")], "doc int, start int, end int, text string")
    m = spark.createDataFrame([(1, 0, 5, "CASSEL", "e1"), (1, 0, 5, "cassel", "e2"), (None, 0, 5, "Cassel", "e3"), (2, 0, 5, "", "e4")], "doc int, start int, end int, text string, mention_id string")
    got = [(r.doc, r.text, r.mention_id) for r in lookups.with_mention(s, m, ["doc"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "Cassel", "e2"), (1, "Cassel", "e2"), (1, None, None), (None, "Cassel", None), (2, "", "e4")], key=str)
    assert lookups.with_mention(s.limit(0), m, ["doc"]).count() == 0 and lookups.with_mention(s, m.limit(0), ["doc"]).count() == 5
    new = spark.createDataFrame([("a", None, 1), ("b", "Q2", 2), (None, None, 3)], "text string, wd string, n int")
    old = spark.createDataFrame([("a", "Q1"), ("a", "Q0"), ("b", "Q9"), (None, "Q5")], "text string, wd string")
    assert sorted(tuple(r) for r in lookups.transferred(new, old, ["text"], ["wd"]).where("text is not null").collect()) == [("a", "Q1", 1), ("b", "Q2", 2)]


def test_entities_share_uris_in_text_order(spark):
    columns = "doc string, mention_id string, pos int, text string, label string, wd string, gn string"
    m = spark.createDataFrame([
        ("L1", "e1", 1, "Ossendorf", "E53_Place", "Q1", None), ("L1", "e2", 2, "Ocksendorf", "E53_Place", "Q1", "gn:5"), ("L1", "e3", 3, "Osdorf", "E18_Physical_Thing", None, "5"), ("L1", "e4", 4, "te paard", "Mode_of_Transportation", None, None),
        ("L1", "e5", 5, "de koets", "Mode_of_Transportation", None, None), ("L2", "e1", 1, "Ossendorf", "Iets", "Q1", None), ("L1", "e6", 6, None, None, None, None),
    ], columns)
    got = {(r.doc, r.mention_id): r.uri for r in story.entities(m).collect()}
    assert got["L1", "e1"] == got["L1", "e2"] == "LOC.Ossendorf_Q1" and got["L1", "e3"] == "LOC.Osdorf_5" and got["L1", "e4"] == "MOD.te_paard" and got["L1", "e5"] == "VEH.de_koets"
    assert got["L2", "e1"] == "LOC.Ossendorf_Q1" and got["L1", "e6"] is None
    rooms = spark.createDataFrame([("L1", "e1", "e3"), ("L1", "e1", "e2"), ("L1", "e9", "e3")], "doc string, room string, building string")
    assert {tuple(r) for r in story.sections(rooms, story.entities(m)).collect()} == {("LOC.Osdorf_5", "P59", "LOC.Ossendorf_Q1"), ("LOC.Ossendorf_Q1", "P59i", "LOC.Osdorf_5")}


def test_a_story_without_events_or_mentions(spark):
    from vellumflow.operators import relations

    answers = spark.createDataFrame([("L1", '{"events": [{"id": "RS1", "type": "stay", "label": "x", "took_place_at": "e1", "near_places": ["e9"], "sub_events": [{"id": "RS2", "type": "indoor_tour", "on_or_within": "e2"}]}, {"type": "stay"}]}'), ("L2", "geen JSON"), ("L3", None)], "doc_id string, body string")
    m = spark.createDataFrame([("L1", "e1", 1, "Cassel", "E53_Place", "Q1", None), ("L1", "e2", 2, "Slot", "E18_Physical_Thing", None, None), ("L2", "e1", 1, "Kleef", "E53_Place", None, None)], "doc string, mention_id string, pos int, text string, label string, wd string, gn string")
    t = {tuple(r) for r in story.triples(relations.events(answers), m).collect()}
    assert {("L1.RS1", "P7", "LOC.Cassel_Q1"), ("L1.RS2", "P8", "LOC.Slot"), ("L1.RS2", "P10i", "L1.RS1"), ("L1.RS", "P10", "L1.RS1"), ("L1.RS2", "P132", "L1.RS1"), ("L2", "P67", "LOC.Kleef"), ("L2.RS", "conveys", "CT.L2.e1")} <= t
    assert not [x for x in t if x[1] == "proximity" or "e9" in x[2]]
    empty = story.triples(relations.events(answers.limit(0)), m.limit(0))
    assert empty.count() == 1 or empty.count() == 0


def test_counts_of_an_empty_graph(spark):
    none = spark.createDataFrame([], "s string, p string, o string")
    assert tuple(story.counts(none).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert story.report(none).count() == 0 and story.attributes(none).count() == 0
    coverage = lookups.citation_coverage(spark.createDataFrame([], "mention_id string, category string"), none, ("IN", "NO_REL"))
    assert sorted(tuple(r) for r in coverage.collect()) == [("IN", 0, 0, 0, ""), ("NO_REL", 0, 0, 0, "")]


def test_routes_with_a_cycle_behind_a_head_end(spark):
    rng = random.Random(3)
    for _ in range(4):
        links = {(f"n{a}", f"n{b}") for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(13)) if a != b}
        t = spark.createDataFrame([(a, "P183", b) for a, b in links], "s string, p string, o string")
        out = {}
        for a, b in links:
            out.setdefault(a, []).append(b)
        heads = {a for a, _ in links} - {b for _, b in links}
        wanted = set()
        for h in heads:
            at, depth, seen = h, 0, {}
            while at not in seen:
                seen[at] = depth
                if len(out.get(at, [])) != 1:
                    break
                at, depth = out[at][0], depth + 1
            wanted |= {(h, e, d) for e, d in seen.items()}
        assert {tuple(r) for r in graph.route(t).collect()} == wanted, links


def test_template_and_gold_documents(spark):
    p = spark.createDataFrame([(1, 1, 1, "  Cassel, Kleef"), (1, 2, 2, "Kleef kleef")], "doc int, page int, seq int, text string")
    e = spark.createDataFrame([(1, 1, 1, 2, 8, "Cassel", "P", "Q1", None), (1, 2, 2, 0, 5, "Kleef", "P", None, None), (1, 2, 3, 6, 11, "kleef", "P", None, "7")], "doc int, page int, id int, start int, end int, text string, label string, wd string, gn string")
    rows = sorted(tuple(r) for r in gold.template(e, p, ["doc"]).collect())
    assert rows == [(1, 1, "Cassel", "P", 0, 6, "Q1", ""), (1, 2, "Kleef", "P", 13, 18, "", "")]
    assert gold.template(e.limit(0), p, ["doc"]).count() == 0


def test_spans_that_are_lost_are_counted(spark):
    s = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 3, 99), (2, 3, 0, 1)], "doc int, id int, start int, end int")
    c = spark.createDataFrame([(1, 0, 10, 0, 10, 0)], "doc int, raw_start int, raw_end int, content_start int, content_end int, out_start int")
    assert sorted(tuple(r) for r in pages.remap_counts(s, c, ["doc"]).collect()) == [(1, 2, 1, 1), (2, 1, 0, 1)]


def test_answers_are_asked_again(spark):
    def model(prompt):
        if prompt == "stuk":
            raise OSError
        return "{" if prompt == "half" else "[1]" if prompt == "lijst" else 'ja {"a": {"b": 1}}'

    df = spark.createDataFrame([("goed",), ("goed",), ("half",), ("stuk",), ("lijst",), (None,)], "prompt string")
    got = {r.prompt: (r.body, r.attempts, r.failed) for r in external.asked_json(df, model).collect()}
    assert got == {"goed": ('{"a": {"b": 1}}', 1, False), "half": (None, 3, True), "stuk": (None, 3, True), "lijst": (None, 3, True)}


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "status string, total_lines int, corrected_lines int, unmatched_lines int, confidence double, fuzzy_accuracy double, gt_chars_total int, gt_chars_mapped int")
    row = runs.correction_summary(none).first()
    assert row.total is None and row.corrected_pct is None and row.no_gt == 0
    files = spark.createDataFrame([("a_t1.0_thinklow_el", "stuk"), (None, None)], "name string, info string")
    assert [(r.name, r.settings) for r in runs.salvaged(files, "1.0", "0.1", {"t": 0.1}).orderBy(F.desc_nulls_last("name")).collect()][0][0] == "a_t0.1_thinklow_el"


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: types.SimpleNamespace(get=lambda k: None))
    cluster = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_similar_lines_are_found_where_they_begin():
    text = "een twee drie vier vijf zes zeven acht negen tien elf"
    assert align.tile(text, ["drie vier vijf zos zeven ocht"])[0][:2] == (9, 38)
    assert align.tile(text, ["nul vier vijf zes zeven ocht"])[0][2] == "similar" and align.tile(text, ["drie vler vijf zos zeven ocht"]) == [None]
    assert align.tile("", ["een twee drie vier"]) == [None] and align.tile(text, []) == []
