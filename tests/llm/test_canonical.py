import random

from vellumflow.llm import canonical

ENTRIES = [
    (1, 10, ["Nieuw Grüggodyk", "Nieuw Gruggodyk"]),
    (2, 5, ["Snörkenggenau", "Jeiphilière"]),
    (3, 900, ["Klein-Silmefforst"]),
    (4, 7, ["Mältudwende"]),
    (5, 90, ["Mältudwende"]),
]


NAMES = [(i, r, k == 0, name) for i, r, names in ENTRIES for k, name in enumerate(names)]


def test_resolver_stages():
    r = canonical.Resolver(NAMES)
    for text, wanted in {
        "het dorp Nieuw Grüggodyk": 1, "NIEUW GRUGGODYK,": 1, "Nieuw-Grüggodyk's": 1, "Nieuw Gr.": 1,
        "Jeyphilière": 2, "Snörkengenau": 2, "Snörkengegnau": 2, "Klein-Silemfforst": 3, "Maeltudwende": 5, "Mält.": 5,
        "de herberg": -1, "": -1, "   ": -1, "?": -1, "Kniritelmonde": -1, "te": -1,
    }.items():
        assert -r.resolve(text)[-1] == wanted, text


def test_distance_matches_brute_force():
    import itertools

    def brute(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(brute(a[1:], b) + 1, brute(a, b[1:]) + 1, brute(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            d = min(d, brute(a[2:], b[2:]) + 1)
        return d

    words = ["".join(x) for n in range(4) for x in itertools.product("ab", repeat=n)]
    for a in words:
        for b in words:
            assert canonical.distance(a, b, 9) == brute(a, b)
            assert canonical.distance(a, b, 1) == min(brute(a, b), 2)


def _random_names(rng, n):
    word = lambda: "".join(rng.choice("abcdeiorstnm") for _ in range(rng.randint(2, 7)))
    words = [word() for _ in range(12)] + ["ijsel", "ysel", "schoon", "sgoon"]
    return [(rng.randint(1, n), rng.choice([0, 5, 5, 900]), rng.random() < 0.5, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for _ in range(n)], words


def _values(rng, names, words, n):
    out = []
    for _ in range(n):
        text = list(rng.choice(names)[3] if rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(3)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", " ", "te "])
        out.append("".join(text)[: rng.choice([4, 99, 99])] + rng.choice(["", "", "."]))
    return out


def test_shards_give_the_answer_of_one_list():
    rng = random.Random(2)
    for _ in range(15):
        names, words = _random_names(rng, 40)
        whole = canonical.Resolver(names)
        for size in (1, 4, 15):
            parts = [canonical.Resolver(names[k : k + size]) for k in range(0, len(names), size)]
            for v in _values(rng, names, words, 40):
                assert max(p.resolve(v) for p in parts) == whole.resolve(v), (v, size)


def test_an_exact_name_wins_over_a_part_of_it_in_another_shard():
    names = [(1, 10, True, "Nieuw Amsterdam"), (2, 1000, True, "Amsterdam")]
    assert max(canonical.Resolver([n]).resolve("Nieuw Amsterdam") for n in names)[-1] == -1
    assert canonical.Resolver(names).resolve("Nieuw Amsterdam")[-1] == -1


def test_no_similar_name_is_left_out_before_it_is_compared():
    rng = random.Random(4)
    close = 0
    for _ in range(20):
        names, words = _random_names(rng, 60)
        r = canonical.Resolver(names)
        for v in _values(rng, names, words, 60):
            core = canonical.words_of(v)
            skeletons, raw = [canonical.skeleton(w) for w in core], "".join(core)
            if len("".join(skeletons)) < 4:
                continue
            fits = [(*fit, *r.targets[n][3]) for n in range(len(r.targets)) if (fit := r.similarity(skeletons, raw, n))]
            close += bool(fits)
            assert r._similar(core) == (max(fits) if fits else None), v
    assert close > 300


def test_linked(spark):
    gaz = spark.createDataFrame([(i, n[0], n[0], ",".join(n[1:]) or None, r) for i, r, n in ENTRIES] + [(6, None, None, "", None)], "geonameid long, name string, asciiname string, alternatenames string, population long")
    rows = [
        (1, "Mältudwende", "4"), (2, "Maeltudwende", " 4.0"), (3, "Maeltudwende", "https://g.example/3/"), (4, "xx", "4E0"), (5, "Snörkengenau", "99"),
        (6, None, None), (7, "", "NIL"), (8, "Snörkengenau", None), (8, "Snörkengenau", None), (9, "word " * 2000, "?"), (10, None, "[2]"), (11, "x", "9" * 30),
    ]
    df = spark.createDataFrame(rows, "mention_id long, text string, geonames_id string").withColumn("how", canonical.F.lit(1))
    got = sorted((r.mention_id, r.geonameid, r.how) for r in canonical.linked(df, gaz).collect())
    assert got == [(2, 4, "id"), (3, 3, "id"), (4, 4, "id"), (5, 2, "spelling"), (6, -1, "none"), (7, -1, "none"), (8, 2, "spelling"), (8, 2, "spelling"), (9, -1, "none"), (10, 2, "id"), (11, -1, "none")]
    for size in (1, 3):
        assert got == sorted((r.mention_id, r.geonameid, r.how) for r in canonical.linked(df, gaz, max_names=size).collect()), size
    assert canonical.linked(df.limit(0), gaz).count() == 0
    assert {r.geonameid for r in canonical.linked(df, gaz.limit(0)).collect()} == {-1}
