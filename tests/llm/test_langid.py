from pyspark.sql import functions as F

from vellumflow.llm import langid

TEXTS = {
    "nl": "De waard bood ons wyn aan en de weg was niet goed. Het water bleef by het raam en wy gingen door naar het dorp.",
    "de": "Der Wirt bot uns Wein an und der Weg war nicht gut. Das Wasser blieb am Fenster und wir gingen zu dem Dorf.",
    "fr": "L'hôte nous offrit du vin et la route n'était pas bonne. Nous allâmes dans le village avec la dame de la maison.",
    "en": "The host offered us wine and the road was not good. The water stayed by the window and we went on to the village.",
    "la": "Hospes nobis vinum dedit et via non erat bona. Aqua ad fenestram erat sed nos in vicum cum amicis venimus.",
}


def _docs(spark):
    rows = [(i * 10 + k, t, c) for i, (c, t) in enumerate(TEXTS.items()) for k in range(4)]
    rows += [
        (100, TEXTS["de"], "nl"), (101, TEXTS["fr"], None), (102, TEXTS["nl"] + "\n\n" + TEXTS["en"], "nl"), (103, TEXTS["nl"], "Nederlands"),
        (104, TEXTS["en"], "en-GB"), (105, None, "nl"), (106, "", "xx"), (107, "12 34", None), (108, TEXTS["la"] * 500, "??"), (100, TEXTS["de"], "nl"), (109, TEXTS["nl"] + " (Gott sei Dank)", "nl"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit("clash"))


def test_languages(spark):
    docs = _docs(spark)
    model = langid.fitted(docs)
    got = {}
    for r in langid.languages(docs, model).collect():
        got[r.doc_id] = (r.wrong, sorted(r.held) if r.held is not None else None, r.found)
    assert got[100] == (True, ["de"], "de") and got[101] == (True, ["fr"], "fr")
    assert got[102][:2] == (True, ["en", "nl"])
    assert not got[103][0] and not got[104][0] and not got[109][0] and not any(got[i * 10][0] for i in range(5))
    assert got[105][0] is False and got[106][:2] == (False, []) and got[107][0] is False
    assert got[108][:2] == (True, ["la"])
    assert langid.languages(docs, model).count() == docs.count()
    assert langid.languages(docs.limit(0), model).count() == 0


def test_passages_tile_sentences(spark):
    model = langid.fit([(c, t) for c, t in TEXTS.items()] * 3)
    text = TEXTS["nl"] + " " + TEXTS["fr"]
    (rows,) = langid.passages_of([text], langid.Scorer(model))
    assert [r[2] for r in rows] == ["nl", "fr"] and rows[0][0] == 0 and rows[-1][1] == len(text)
    assert all(0 < r[3] <= 1 for r in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.c, r.text) for r in docs.select(langid.language_of(F.col("lang")).alias("c"), "text", "doc_id").where("c is not null").orderBy("doc_id").collect()]
    model = langid.fit(rows[::2])
    held = rows[1::2]
    found = langid.passages_of([t for _, t in held], langid.Scorer(model))
    right = sum(any(p[2] == c for p in ps) for (c, _), ps in zip(held, found))
    assert right / len(held) > 0.85  # about a tenth of the labels are wrong
