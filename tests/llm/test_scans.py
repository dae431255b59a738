import random

from pyspark.sql import functions as F

from vellumflow.llm import scans

WORDS = "wagen bruggen molenaar toren straten kerkhof huizen velden water bergen dalen steden dorpen poorten markten pleinen tuinen kasteel rivieren marktmeester noord-oostelyke".split()
LINE = "struct<line_id:string,custom:string,coords:struct<points:string>,baseline:struct<points:string>,text_equiv:array<struct<conf:double,plain_text:string,unicode_text:string>>>"
SUB = f"struct<region_id:string,custom:string,coords:struct<points:string>,text_lines:array<{LINE}>>"
SCHEMA = f"rec_id long, volume string, scan_number int, reading_order array<struct<idx:int,region_ref:string>>, regions array<struct<region_id:string,custom:string,coords:struct<points:string>,text_lines:array<{LINE}>,sub_regions:array<{SUB}>>>, lines string"


def _line(k, text):
    return (f"l{k}", f"readingOrder {{index:{k};}}", None, None, None if text is None else [(0.9, text, text)])


def _scans(spark):
    rng = random.Random(4)
    rows = []
    for s in range(1, 13):
        body = [" ".join(rng.choice(WORDS) for _ in range(7)) for _ in range(20)]
        lines = [f"REIZE DOOR DE WITTE LANDEN. {s + 30}"] + body if s % 2 else [f"— {s + 30} —"] + body
        rows.append([s, "v1", s, lines])
    page = rows[2][3]
    page[3] = "wagen straten markt-"
    page[4] = "meester toren water"
    page[6] = "velden kastee1 dalen"
    page[8] = "velden noord-"
    page[9] = "oostelyke dalen toren"
    page[11] = "bergen dor"
    page[12] = "pen wagen water"
    page[14] = "velden wyn-"
    page[15] = "en dalen toren wat;r"
    page[-1] = "dalen kerk-"
    rows[3][3][1] = "hof wagen water"
    data = [(i, v, s, [(0, "r1")], [("r1", None, None, [_line(k, t) for k, t in enumerate(ls)][::-1], [("m", None, None, [_line(0, "margln n0te")])])], "x") for i, v, s, ls in rows]
    data += [(50, "v1", 3, None, [("r1", "readingOrder {index:0;}", None, [_line(k, t) for k, t in enumerate(rows[2][3])], None)], "x")]
    data += [(60, None, None, None, None, "x"), (61, "v2", 1, None, [None, ("r1", None, None, None, None)], "x"), (62, "v2", 2, [], [("r1", None, None, [None, _line(0, None), _line(1, ""), _line(2, "water " * 5000)], [])], "x")]
    return spark.createDataFrame(data, SCHEMA)


def test_noise(spark):
    df = _scans(spark)
    got = {(r.rec_id, r.line_id, r.noise) for r in scans.noise(df).collect()}
    assert {(s, "l0", "header") for s in range(1, 13, 2)} | {(s, "l0", "page_no") for s in range(2, 13, 2)} <= got
    page = {(k, n) for i, k, n in got if i == 3}
    assert page == {("l0", "header"), ("l3", "broken_word"), ("l6", "misread"), ("l8", "broken_word"), ("l11", "broken_word"), ("l15", "misread"), ("l20", "broken_word")}
    assert {(k, n) for i, k, n in got if i == 50} == page
    assert not [x for x in got if x[0] > 50]
    assert not [x for x in got if x[2] not in ("header", "page_no") and x[0] not in (3, 50)]
    assert scans.noise(df.limit(0)).count() == 0


def test_paragraphs(spark):
    df = _scans(spark)
    rows = scans.paragraphs(df).where("volume = 'v1'").collect()
    text = " ".join(r.text for r in rows)
    assert "marktmeester" in text and "noord-oostelyke" in text and "kerkhof wagen" in text and "kasteel dalen" in text
    assert "WITTE LANDEN" not in text and "margln" not in text and "wyn- en dalen" in text
    assert scans.paragraphs(df.limit(0)).count() == 0


def test_page_numbers_and_titles():
    for line in ("— 5O —", "pag. l46", "( 37 )", "[197]", "53", "xii", "15½", "- 22 -"):
        assert scans.is_page_number(line), line
    for line in ("5 stuivers", "en", "", "—", "wagen 12"):
        assert not scans.is_page_number(line), line
    assert scans.noise_lines(["53", "wagen", "water", "17"], [], 53) == ["page_no", "", "", ""]
    assert scans.noise_lines([], []) == []


def test_boundaries_bound_every_paragraph():
    assert scans.boundaries([], []) == [] and scans.boundaries([1.0], [1]) == []
    for n in range(2, 90):
        got = scans.boundaries([3.0] * n, list(range(n)) if n % 2 else [1] * n)
        cuts = [0, *got, n]
        assert got == sorted(set(got)) and all(b - a <= (5 if n % 2 else 24) for a, b in zip(cuts, cuts[1:]))
    assert scans.boundaries([1.0] * 5 + [0.0] + [1.0] * 5, [1] * 11) == [5]


def _brute_boundaries(costs, scans_, usual=6, reach=4):
    n, best = len(costs), (float("inf"), [])
    for mask in range(1 << (n - 1)):
        cuts = [0, *(k for k in range(1, n) if mask >> (k - 1) & 1), n]
        cost = sum(costs[k] for k in cuts[1:-1])
        for a, b in zip(cuts, cuts[1:]):
            cost += ((b - a - usual) / usual) ** 2 if scans_[b - 1] - scans_[a] <= reach else float("inf")
        best = min(best, (cost, cuts[1:-1]))
    return best[0]


def test_boundaries_equal_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(2, 11)
        costs = [rng.choice([0.2, 1.0, 2.0, -100.0]) for _ in range(n)]
        where = sorted(rng.randint(1, 9) for _ in range(n))
        cuts = [0, *scans.boundaries(costs, where), n]
        cost = sum(costs[k] for k in cuts[1:-1]) + sum(((b - a - 6) / 6) ** 2 for a, b in zip(cuts, cuts[1:]))
        assert abs(cost - _brute_boundaries(costs, where)) < 1e-9


def test_words_of_a_stream_equal_brute_force():
    rng = random.Random(11)
    words = {w: rng.randint(5, 400) for w in "van het huis huizen de den gewoon woon ge wagen en markt meester marktmeester toren rent torent".split()}
    lexicon = scans.Lexicon(words, {("ge", "woon"): 7}, {}, 9000)

    def cheapest(lines, apart):
        tokens = [t for x in lines for t in x]
        ends, k = {}, 0
        for x, a in zip(lines, apart):
            k += len(x)
            ends[k] = a

        def rest(k):
            if k == len(tokens):
                return 0.0
            gap = 0.0
            if 0 < k:
                gap = (lexicon.across(tokens[k - 1], tokens[k], ends[k]) if k in ends else lexicon.within(tokens[k - 1], tokens[k]))[1]
            at_end = k + 1 in ends
            t = tokens[k]
            out = lexicon.whole(t.rstrip(scans.HYPHENS) if at_end else t) + rest(k + 1)
            if not (at_end and t[-1] in scans.HYPHENS):
                out = min(out, lexicon.divided(t)[0] + rest(k + 1))
            if k + 1 < len(tokens):
                one = (lexicon.across(t, tokens[k + 1], ends[k + 1]) if at_end else lexicon.within(t, tokens[k + 1]))[0]
                out = min(out, one + rest(k + 2))
            return gap + out

        return rest(0)

    def cost(lines, apart, found):
        tokens = [t for x in lines for t in x]
        ends, k, out = {}, 0, 0.0
        for x, a in zip(lines, apart):
            k += len(x)
            ends[k] = a
        for w in found:
            pair = lambda i: lexicon.across(tokens[i - 1], tokens[i], ends[i]) if i in ends else lexicon.within(tokens[i - 1], tokens[i])  # noqa: B023, E731
            out += pair(w.start)[1] if w.start else 0.0
            t = tokens[w.start]
            if w.end - w.start == 1:
                out += lexicon.divided(t)[0] if w.at else lexicon.whole(t.rstrip(scans.HYPHENS) if w.end in ends else t)
            else:
                out += pair(w.end - 1)[0]
        return out

    forms = [*words, "vanhet", "huls", "marktmcester", "mees", "ter", "hui", "zen", "Xyz", "to", "ge-", "markt-", "hui-"]
    for _ in range(300):
        lines = [[rng.choice(forms) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 3))]
        apart = [False] * len(lines)
        assert abs(cost(lines, apart, scans.words_of_stream(lines, apart, lexicon)) - cheapest(lines, apart)) < 1e-6


def test_words_are_divided_joined_and_corrected_in_the_stream():
    words = dict.fromkeys("in van het huis gewoon water marktschip kerk buurman riep by vuur".split(), 50)
    lexicon = scans.Lexicon(words, {}, {}, 6000)
    out = scans.decode(["water vanhet huis ge woon", "water markt-", "scbip by het kcrk", "buurman"], [], None, None, None, lexicon)
    assert [" ".join(t for t in x.texts if t) for x in out] == ["water van het huis gewoon", "water marktschip", "by het kerk", "buurman"]
    assert [x.broken for x in out] == [False, True, False, False] and [any(x.wrong) for x in out] == [False, False, True, False]


def test_a_heading_does_not_cut_a_sentence():
    words = dict.fromkeys("want myn buurman riep by het vuur den wynglas stond daar".split(), 50)
    lexicon = scans.Lexicon(words, {}, {}, 6000)
    lines = ["want myn buurman riep", "ACHTSTE DAG.", "by het vuur. den wyn-", "TWEEDE HOOFDSTUK.", "glas stond daar. myn"]
    one, two = (scans.pieces_of(scans.decode(ls, [], None, None, None, lexicon)) for ls in (lines, ["buurman riep.", "daar stond het."]))
    got = scans.paragraphs_of([(1, one), (2, two)], 0)
    assert got == [
        (1, 0, "want myn buurman riep by het vuur."), (1, 1, "ACHTSTE DAG."), (1, 2, "den wynglas stond daar."),
        (1, 3, "TWEEDE HOOFDSTUK."), (1, 4, "myn buurman riep. daar stond het."),
    ]


def test_groups_of_scans_give_every_sentence_once():
    rng = random.Random(13)
    pages, n = [], 0
    for s in range(200):
        own = []
        for _ in range(rng.choice([0, 1, 1, 3, 8])):
            n += 1
            own.append(scans.Piece(f"w{n}", rng.random() < 0.7, 1.0, rng.random() < 0.1))
        if rng.random() < 0.95:
            pages.append((s, own))
    out = []
    for g in range(14):
        out += scans.paragraphs_of([(s, p) for s, p in pages if g * scans.GROUP - 1 <= s <= (g + 1) * scans.GROUP + 5], g)
    held = " ".join(t for *_, t in out).split()
    assert sorted(held) == sorted(p.text for _, own in pages for p in own) and len(held) == len(set(held))
    assert len({(s, k) for s, k, _ in out}) == len(out) and max(len(t.split()) for *_, t in out) < 80


def test_a_lexicon_beyond_its_bound_gives_the_same(spark, monkeypatch):
    df = _scans(spark)
    noise = sorted(map(tuple, scans.noise(df).collect()))
    text = sorted(map(str, scans.paragraphs(df).collect()))
    monkeypatch.setattr(scans, "MAX_LEXICON", 3)
    assert noise == sorted(map(tuple, scans.noise(df).collect()))
    assert text == sorted(map(str, scans.paragraphs(df).collect()))


def test_digits_in_words_are_misread_at_every_size():
    for size in (1, 10, 100):
        words = {"door": 400 * size, "kasteel": 50 * size, "do0r": 4 * size, "kast^el": 4 * size, "n/m": 30 * size}
        lexicon = scans.Lexicon(words, {}, {}, sum(words.values()))
        assert [lexicon.misread(t) for t in ("do0r", "Do0r,", "kast^el", "n/m", "door")] == [True, True, True, False, False], size
        assert scans.corrected("do0r", lexicon) == "door"


def test_titles_of_few_scans_are_told_in_a_long_volume(spark):
    rng = random.Random(7)
    rows = []
    for s in range(1, 121):
        body = [" ".join(rng.choice(WORDS) for _ in range(7)) for _ in range(6)]
        # Every chapter of eight scans has its own title on two of them, misread on the second.
        name = "".join(rng.choice("abdegklmoprstvz") for _ in range(9)) if s % 8 == 1 else name
        head = {2: f"{s} Van {name} naar telangen", 4: f"{s} Van {name} naar te1angcn", 6: f"HOOFDSTUK {'I' * (s // 8 + 1)}."}.get(s % 8)
        rows.append((s, "v1", s, None, [("r1", None, None, [_line(k, t) for k, t in enumerate([head] * bool(head) + body)], None)], "x"))
    got = {r.rec_id for r in scans.noise(spark.createDataFrame(rows, SCHEMA)).where("noise = 'header'").collect()}
    assert got == {s for s in range(1, 121) if s % 8 in (2, 4)}


def test_a_title_recurs_on_the_same_edge_and_near():
    form = ("van hier naar ginder", True, "", True)
    assert scans.near_titles([(1, [form]), (9, [form])]) == {1: [form[0]], 9: [form[0]]}
    assert scans.near_titles([(1, [form]), (10, [form])]) == {}
    assert scans.near_titles([(1, [form]), (2, [(form[0], False, "", True)])]) == {}
    assert scans.near_titles([(1, [form]), (1, [form])]) == {}
