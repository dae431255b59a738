import random
import time

import numpy as np

from vellumflow.llm import leaks

WORDS = "wagen brug molen toren straat kerk huis veld water berg dal stad dorp poort markt plein tuin hof kasteel rivier".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def _flat(docs, vocabulary):
    return [x for k, d in enumerate(docs) for x in (*(vocabulary[w] for w in leaks.written_words(d)), -2 - k)]


def test_suffix_array_is_the_order_of_all_suffixes():
    rng = random.Random(3)
    for n in (0, 1, 2, 40, 300):
        docs = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, n))) for _ in range(4)] * 2
        flat = _flat(docs, leaks.Vocabulary())
        assert leaks.suffix_array(np.array(flat)).tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
    assert len(leaks.suffix_array(np.zeros(0, int))) == 0


def test_longest_matches_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for pairs in (3, leaks.PAIRS):
        monkeypatch.setattr(leaks, "PAIRS", pairs)
        block = leaks.Items([(i, " ".join(rng.choice("abcd") * 3 for _ in range(rng.randint(0, 12)))) for i in range(6)])
        vocabulary = leaks.Vocabulary()
        flat = _flat([" ".join(rng.choice("abce") * 3 for _ in range(30)) for _ in range(4)], vocabulary)
        wanted = block.tokens(vocabulary)
        got = [x for part in leaks.longest_matches(np.array(flat), leaks.suffix_array(np.array(flat)), wanted, block.ends, 2) for x in zip(*(y.tolist() for y in part))]
        brute = set()
        for i in range(len(flat)):
            for j in range(len(wanted)):
                same = lambda k: 0 <= i + k < len(flat) and 0 <= j + k < len(wanted) and block.item[j + k] == block.item[j] and wanted[j + k] >= 0 and flat[i + k] == wanted[j + k]  # noqa: B023, E731
                n = next(k for k in range(99) if not same(k))
                if n >= 2 and not same(-1):
                    brute.add((i, j, n))
        assert set(got) == brute and len(got) == len(brute)


def test_wrong_words_at_every_third_to_sixth_place_are_found():
    rng = random.Random(5)
    items = [(i, _text(rng, rng.randint(60, 130))) for i in range(40)]
    for every in (2, 3, 4, 5, 6):
        docs = [(i, _text(rng, 80) + " " + " ".join("fout" if k % every == every - 1 else w for k, w in enumerate(t.split())) + " " + _text(rng, 80)) for i, t in items]
        found = {(k, i) for k, i, *_ in leaks.leaks_of(docs, iter([leaks.Items(items)]))}
        # With every second word wrong no two words stand together, which is what a match needs.
        assert found == (set() if every == 2 else {(i, i) for i, _ in items}), every


def test_a_wrong_word_counts_as_held_but_does_not_agree():
    item = _text(random.Random(6), 60)
    doc = " ".join("fout" if k % 4 == 3 else w for k, w in enumerate(item.split()))
    ((_, _, agree, part),) = leaks.leaks_of([(1, doc)], iter([leaks.Items([(1, item)])]))
    assert agree == 45 and part >= 59 / 60


def test_a_repeated_phrase_costs_no_more_than_its_words():
    rng = random.Random(8)
    phrase = _text(rng, 10)
    items = [(i, phrase + " " + _text(rng, 40) + " " + phrase + " " + _text(rng, 40)) for i in range(20)]
    docs = [(1, (phrase + " ") * 600)]
    began = time.time()
    assert leaks.leaks_of(docs, iter([leaks.Items(items)])) == []
    assert time.time() - began < 5


def test_leaks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, _text(rng, 60)) for i in range(5)]
    words = items[0][1].split()
    noisy = [w if k % 7 else "fout" for k, w in enumerate(items[1][1].upper().split())]
    docs = [
        (1, _text(rng, 50) + " " + items[0][1] + " " + _text(rng, 50)),
        (2, " ".join(words[20:55])),  # more than half
        (3, " ".join(words[:20])),  # too little
        (4, " ".join(noisy).replace(" ", "\n", 3)),
        (5, " ".join(words[:15]) + " " + _text(rng, 60) + " " + " ".join(words[15:30])),  # not connected
        (6, None), (7, ""), (8, _text(rng, 3000)), (1, items[0][1]), (9, items[2][1] + ". " + items[3][1]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", leaks.F.lit(0))
    it = spark.createDataFrame(items + [(9, None), (10, "")], "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()})
    assert got == [(1, 0), (2, 0), (4, 1), (9, 2), (9, 3)]
    assert sorted(r.doc_id for r in leaks.clean(df, it).collect()) == [3, 5, 6, 7, 8]
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    assert got == sorted({(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()})
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0
