"""Readers, sinks, external functions and streams on small files."""

import json

from pyspark.sql import functions as F

from vellumflow import external
from vellumflow.sources import readers, sinks
from vellumflow.streaming import runs as stream


def test_page_xml(spark, tmp_path):
    xml = """<?xml version="1.0"?><PcGts xmlns="http://x"><Page imageFilename="a.jpg"><ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="0" regionRef="r2"/></OrderedGroup></ReadingOrder>
    <TextRegion id="r1"><TextLine id="l1"><Coords points="1,2 3,4"/><TextEquiv conf="0.5"><PlainText>een</PlainText><Unicode>eén</Unicode></TextEquiv></TextLine></TextRegion>
    <TextRegion id="r2"><TextLine><Baseline points="5,6"/><TextEquiv><PlainText/></TextEquiv></TextLine></TextRegion><TextRegion id="r3"><TextLine id="l9"/></TextRegion></Page></PcGts>"""
    (tmp_path / "0552_0179_0030.xml").write_text("﻿" + xml)
    (tmp_path / "0552_0179_0032.xml").write_text("kapot <")
    files = readers.page_xml(spark, str(tmp_path / "*.xml"))
    assert sorted(r.scan for r in files.collect()) == [30, 32]
    by_index = [(r.region_id, r.line_id, r.plain_text, r.unicode_text, r.conf) for r in readers.page_lines(files).where("error is null").orderBy("region_idx", "line_idx").collect()]
    (bad,) = readers.page_lines(files).where("error is not null").collect()
    assert bad.path.endswith("0032.xml") and bad.line_id is None
    assert by_index == [("r2", "r0l0", "", None, None), ("r1", "l1", "een", "eén", 0.5), ("r3", "l9", None, None, None)]
    assert [r.region_id for r in readers.page_lines(files, "document").where("error is null").orderBy("region_idx").collect()] == ["r1", "r2"]


def test_annotations_and_tables(spark, tmp_path):
    ann = [
        {"id": "a", "body": [{"purpose": "commenting", "value": "geonames.org/2856859/\nwikidata.org/wiki/Q2034601"}, {"purpose": "tagging", "value": "Place"}, {"purpose": "georeferencing", "geometry": {"type": "Point", "coordinates": [5.1, 52.0]}}],
         "target": {"selector": [{"type": "TextQuoteSelector", "exact": "Utrecht"}, {"type": "TextPositionSelector", "start": 3, "end": 10}]}},
        {"id": "b", "body": [{"purpose": "commenting", "value": "x"}], "target": {"selector": [{"type": "TextPositionSelector", "start": 1, "end": 2}]}},
    ]
    (tmp_path / "g.jsonld").write_text(json.dumps(ann))
    (row,) = readers.annotations(spark, str(tmp_path / "g.jsonld"), {"Place": "E53_Place"}).collect()
    assert (row.label, row.start, row.end, row.exact, row.wd, row.gn, row.lon) == ("E53_Place", 3, 10, "Utrecht", "Q2034601", "2856859", 5.1)
    (tmp_path / "gold.csv").write_text("﻿text,label,start_char,end_char,wikidata_qid,geonames_id,note\nUtrecht,E53_Place,3,10,NIL,gn:123,\nx,E53_Place,bad,10,Q1,2935704.0,\ny,E53_Place,4,5,None,2935704.0,n\n")
    assert [(r.text, r.wd, r.gn) for r in readers.gold_links(spark, str(tmp_path / "gold.csv")).orderBy("text").collect()] == [("Utrecht", None, "123"), ("y", None, "2935704")]
    (tmp_path / "gaz.txt").write_text("\t".join(["7", "Naam", "Naam", "a,b", "5.5", "x", "P", "PPL", "NL", "", "11", "", "", "", "9", "z"]) + "\nkort\tte\n")
    (g,) = readers.gazetteer(spark, str(tmp_path / "gaz.txt")).collect()
    assert (g.geonameid, g.lat, g.lon, g.population, g.elevation, g.admin1_code) == (7, 5.5, 0.0, 9, 0, "11")
    (tmp_path / "m.json").write_text(json.dumps({"e1": {"text": "x", "label": "L", "kb_id_wikidata": "Q1", "start": 1, "end": 2}}))
    assert readers.mention_map(spark, str(tmp_path / "m.json")).first().wd == "Q1"
    (tmp_path / "scan.csv").write_text("Scan Number,Page Number\n17,XII\nx,1\n19,XII\n")
    mapping = readers.scan_map(spark, str(tmp_path / "scan.csv"))
    assert mapping.count() == 2 and readers.page_to_scan(mapping).first().scan == 19
    (tmp_path / "scan2.csv").write_text("Scan Number,Page Number\n9,16\n3,16\n4,17\n5,x\n")
    mapping = readers.scan_map(spark, str(tmp_path / "scan2.csv"))
    assert {r.page: r.scan for r in readers.page_to_scan(mapping).collect()} == {"16": 3, "17": 4, "x": 5}
    lines = spark.createDataFrame([(3, 0, 1, "b", "twee"), (3, 0, 0, "a", "een"), (4, 0, 0, "c", " "), (9, 0, 0, "d", "niet"), (5, 0, 0, "e", None)], "scan int, region_idx int, line_idx int, line_id string, text string")
    texts, spans = readers.page_texts(lines, mapping)
    assert [tuple(r) for r in texts.collect()] == [("16", 3, "een\ntwee")]
    assert sorted(tuple(r) for r in spans.collect()) == [("16", 0, 0, 4, "a"), ("16", 1, 4, 9, "b")]
    assert [(r.page, r.line_id) for r in readers.pages_in_range(lines, mapping, 16, 25).collect()] == [("16", "a"), ("16", "b"), ("17", "c")]
    assert {r.scan: r.empty for r in readers.is_empty_page(lines).collect()} == {3: False, 4: True, 5: True, 9: False}
    (tmp_path / "letter_1.txt").write_text("﻿tekst\nregel")
    row = readers.letters(spark, str(tmp_path / "letter_1.txt")).first()
    assert (row.letter_id, row.text) == ("letter_1", "tekst\nregel")


def test_turtle_round(spark, tmp_path):
    text = '@prefix ex: <http://x/> .\n@prefix s: <http://s#> .\nex:BRF.RS.1 a ex:E7, ex:E9 ;\n    s:label "een \\"ding\\"" ;\n    s:match <http://q/Q1> .\nex:b ex:p ex:c .\nex:b ex:p ex:c .\n'
    (tmp_path / "g.ttl").write_text(text)
    got = sorted((r.s, r.p.rpartition("/")[2].rpartition("#")[2], r.o, r.o_is_literal) for r in readers.turtle(spark, str(tmp_path / "g.ttl")).collect())
    assert got == [("http://x/BRF.RS.1", "label", 'een "ding"', True), ("http://x/BRF.RS.1", "match", "http://q/Q1", False), ("http://x/BRF.RS.1", "type", "http://x/E7", False), ("http://x/BRF.RS.1", "type", "http://x/E9", False), ("http://x/b", "p", "http://x/c", False)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.1, "few", "nl", 1)], "model string, temperature double, mode string, language string, n int")
    sinks.append_scores(df, str(tmp_path / "log"))
    sinks.append_scores(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_run(df, str(tmp_path / "run"))
    sinks.write_run(df, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run")).count() == 1
    assert sinks.evolved(df, df.withColumn("new", F.lit(2))).where("new is null").count() == 1
    errors = spark.createDataFrame([("TP", 1, 5, 5), ("FN", 1, 9, None), ("FP", 1, None, 2)], "type string, page int, gold_start int, pred_start int")
    sinks.write_errors(errors, str(tmp_path / "err"))
    assert [r.type for r in spark.read.csv(str(tmp_path / "err"), header=True).collect()] == ["FN", "FP", "TP"]


def test_external_functions_retry_and_ask_once(spark):
    def flaky(prompt):
        if prompt == "stuk":
            raise TimeoutError
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("a",), ("stuk",), (None,)], "prompt string")
    got = {r.prompt: (r.answer, r.attempts, r.failed) for r in external.asked(df, flaky, waits=(0.0, 0.0)).collect()}
    assert got == {"a": ("A", 1, False), "stuk": (None, 3, True)}
    pages = spark.createDataFrame([(1, "wij zagen Utrecht en Den Haag"), (2, None)], "page int, text string")
    rows = {r.page: (r.spans, r.failed) for r in external.tagged(pages).collect()}
    assert [(s.start, s.end) for s in rows[1][0]] == [(10, 17), (21, 29)] and rows[2] == ([], False)
    assert external.think_argument("true") is True and external.think_argument("low") == "low" and external.think_argument(None) is None


def test_stream_of_run_files(spark, tmp_path):
    files = spark.read.parquet("/root/testdata/sf0.001/run_files.parquet")
    files.write.parquet(str(tmp_path / "in"))
    q = stream.append_to(stream.run_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == files.select("path", "modified_at").distinct().count() and "epg_temp" in out.columns


def test_page_xml_takes_corrections(spark):
    from vellumflow.operators import editions

    xml = '<PcGts xmlns="http://x"><Page><TextRegion id="r"><TextLine id="l1"><TextEquiv conf="0.5"><Unicode>fuot</Unicode></TextEquiv></TextLine><TextLine id="l2"/><TextLine id="l3"><TextEquiv><Unicode>blijft</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>'
    files = spark.createDataFrame([("a.xml", "\ufeff" + xml), ("b.xml", "kapot <"), ("c.xml", None)], "path string, page_xml string")
    fixes = spark.createDataFrame([("a.xml", "l1", "fout & goed"), ("a.xml", "l2", "nieuw"), ("a.xml", "l9", "x"), ("z.xml", "l1", "y"), ("a.xml", None, "n")], "path string, line_id string, text string")
    got = {r.path: r for r in editions.updated_page_xml(files, fixes).collect()}
    assert got["a.xml"].n_updated == 2 and got["a.xml"].error is None and got["b.xml"].error and got["b.xml"].page_xml == "kapot <" and got["c.xml"].n_updated == 0
    lines = {r.line_id: (r.plain_text, r.unicode_text) for r in readers.page_lines(spark.createDataFrame([("a.xml", got["a.xml"].page_xml)], "path string, page_xml string")).collect()}
    assert lines == {"l1": ("fout & goed", "fout & goed"), "l2": ("nieuw", "nieuw"), "l3": (None, "blijft")}


def test_alto_takes_a_graph(spark):
    from vellumflow.operators import editions

    pages = spark.createDataFrame([(1, "<?xml?><alto><Layout/></alto>"), (2, "<?xml?><alto/>")], "page int, xml string")
    graph = spark.createDataFrame([(1, 'ex:a a "<b>" .')], "page int, turtle string")
    got = {r.page: r.xml for r in editions.spliced(pages, graph, ["page"]).collect()}
    assert got == {1: "<?xml?><alto><Description><OtherDescription>ex:a a &quot;&lt;b&gt;&quot; .</OtherDescription></Description><Layout/></alto>", 2: "<?xml?><alto/>"}


def test_labels_are_fetched_in_parts(spark):
    from vellumflow.operators import candidates

    def fetch(own):
        assert len(own) <= 50
        return {i: ({"nl": f"nl {i}"} if int(i[1:]) % 2 else {"en": f"en {i}", "nl": ""}) for i in own if i != "Q7"}

    ids_ = spark.createDataFrame([(f"Q{k}",) for k in range(130)] * 2 + [(None,)], "id string")
    got = {r.id: r.label for r in candidates.fetched_labels(ids_, fetch).collect()}
    assert len(got) == 130 and got["Q3"] == "nl Q3" and got["Q4"] == "en Q4" and got["Q7"] is None


def test_candidates_of_all_lanes(spark):
    from vellumflow.operators import candidates

    mentions = spark.createDataFrame([(1, "Cassel", "E53_Place", "by Cassel", 1), (2, "Cassel", "E53_Place", "", 2), (3, "Kleef", "E53_Place", "", 3), (4, None, "E53_Place", "x", 4), (5, "", "E53_Place", "x", 5)], "mention_id int, text string, label string, context string, pos int")
    index = spark.createDataFrame([("Q1", "nl", "Cassel", "stad", 1), ("Q1", "de", "cassel", "Stadt", 1), ("Q2", "en", "Cassel", "town in Hessenland", 2), ("Q3", "en", "Cassel", "town in France", 3), ("Q4", "de", "Kleef", None, 4)], "id string, lang string, label string, description string, rank long")
    gaz = spark.createDataFrame([(7, "Cassel", "Cassel", None, 5.0, 51.0, "P", "PPL", "DE", "05", 100)], "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, feature_code string, country_code string, admin1_code string, population long")
    pages = spark.createDataFrame([("Cassel", "Kassel", "Q9", 1), ("Cassel", "Niets", None, 2)], "name string, title string, qid string, pos int")
    model = lambda prompt: '{"modern_name": "Cassel", "country_or_region": "Duitsland, Hessenland"}'
    got = {}
    for r in candidates.generated(mentions, index, gaz, model, pages).collect():
        got.setdefault((r.mention_id, r.kb), {})[r.pos] = r.id
    assert got == {(k, kb): v for k in (1, 2) for kb, v in (("wd", {1: "Q1", 2: "Q2", 3: "Q3", 4: "Q9"}), ("gn", {1: "gn:7"}))} | {(3, "wd"): {1: "Q4"}}
    broken = candidates.generated(mentions, index, gaz, lambda p: "geen JSON", pages).collect()
    assert {(r.mention_id, r.id) for r in broken} == {(1, "Q1"), (1, "Q2"), (1, "Q3"), (2, "Q1"), (2, "Q2"), (2, "Q3"), (3, "Q4")}
    assert candidates.generated(mentions.limit(0), index, gaz, model).count() == 0
