import unicodedata

from hypothesis import example, given, settings
from hypothesis import strategies as st

from vellumflow.llm import visual


def test_plain_forms():
    cases = {
        "Ｌａ̈ｎｄ": "Länd",
        "Groot‑Darbeke": "Groot-Darbeke",
        "Kl­ein​": "Klein",
        "Bad　Kn": "Bad Kn",
        "KK": "KK",
        "oﬀen ǌ": "offen nj",
        "Кlein": "Klein",
        "Νieuw ѕtad": "Nieuw stad",
        "": "",
        "Nÿeuw Länd": "Nÿeuw Länd",
        "Сомпик": "Сомпик",
        "aз": "аз",
        "½ ²": "½ ²",
    }
    for given_, wanted in cases.items():
        assert visual.plain(given_) == wanted, given_


def test_other_scripts_stay_unless_something_is_wrong():
    assert visual.plain("Νιεδερ") == "Νιεδερ"
    assert visual.plain("Йоо") == "Йоо"
    assert visual.plain("Νι​εδερ") == "Νιεδερ"
    assert visual.plain("Bad Сомпик") == "Bad Сомпик"
    assert visual.plain("Сoмпик") == "Сомпик"  # a Latin o in a Cyrillic word


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
@example("\U0002f800")
def test_plain_is_stable_and_nfc(text):
    once = visual.plain(text)
    assert visual.plain(once) == once
    assert unicodedata.is_normalized("NFC", once)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aäö̀eз́ﬁＡ", max_size=12))
def test_segments_give_what_whole_texts_give(text):
    folds = visual._classes()[1]
    whole = unicodedata.normalize("NFC", "".join(folds.get(c, c) for c in text))
    assert visual.plain(text) == visual._words_fixed(whole)


def test_not_plain(spark):
    rows = [(1, "a​b", None, "x"), (2, "ab", "Ａ", "y"), (2, "ab", "Ａ", "y"), (3, None, "", "z"), (4, "x" * 100_000 + "​", "ok", "z")]
    df = spark.createDataFrame(rows, "mention_id long, text string, wikidata_label string, field string")
    got = [(r.mention_id, r.field) for r in visual.not_plain(df, "mention_id", ["text", "wikidata_label"]).collect()]
    assert sorted(got) == [(1, "text"), (2, "wikidata_label"), (2, "wikidata_label"), (4, "text")]
    assert visual.not_plain(df.limit(0), "mention_id", ["text"]).count() == 0
    assert [r.text_plain for r in visual.normalized(df.withColumn("text_plain", df.text), ["text"]).orderBy("mention_id").collect()][:2] == ["ab", "ab"]
