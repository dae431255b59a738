import os

import pytest
from pyspark.sql import functions as F

from vellumflow.llm import mixture

pytestmark = pytest.mark.skipif(not os.path.exists(mixture.VOCABULARY), reason="the public vocabulary isn't here")


def _tables(spark):
    docs = [(i, "a b c d e f g h i j" if i % 3 else "x", ["A ", "b", None, "c"][i % 4]) for i in range(2000)]
    docs += [(5000, None, "a"), (5001, "", "a")]
    targets = [("m", "a", 0.5, 1), ("m", "B", 0.4, 3), ("m", "none", 0.1, 4), ("k", "c", 1.0, 2), ("k", None, 0.3, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("h", F.lit(3)), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = _tables(spark)
    got = {(r.mix_name, r.source): r for r in mixture.shares(docs, targets).collect()}
    a, b, none, c = (got[k] for k in (("m", "a"), ("m", "b"), ("m", "none"), ("k", "c")))
    assert a.n_tokens == a.available and a.most_copies == 1
    assert abs(a.actual_share - 5 / 9) < 0.01 and abs(b.actual_share - 4 / 9) < 0.01
    assert none.n_tokens == 0 and none.actual_share == 0 and b.most_copies <= 3
    assert c.n_tokens == 2 * c.available and c.actual_share == 1


def test_selection_is_the_exact_prefix_of_the_hash_order(spark):
    docs, targets = _tables(spark)
    total = 3000
    sized = sorted((r.h, r.n_tokens, r.doc_id) for r in mixture.sizes(docs).where("source = 'b'").collect())
    plan = {r.source: r for r in mixture.budgets(mixture.sizes(docs), targets, total).where("mix_name = 'm'").collect()}
    budget, held = plan["b"].budget, sum(n for _, n, _ in sized)
    whole, left, wanted = budget // held, budget % held, set()
    for h, n, i in sized:
        if n > left:
            break
        left -= n
        wanted.add(i)
    got = {r.doc_id: r.copies for r in mixture.selection(docs, targets, total).where("mix_name = 'm' and source = 'b'").collect()}
    assert {i for i, c in got.items() if c > whole} >= wanted - {sized[0][2]} and sum(c * n for i, c in got.items() for _, n, j in sized if i == j) <= budget
    assert {i for i, c in got.items() if c > whole} == wanted


def test_empty(spark):
    docs, targets = _tables(spark)
    assert mixture.selection(docs.limit(0), targets).count() == 0
    assert mixture.selection(docs, targets.limit(0)).count() == 0
    assert {r.n_tokens for r in mixture.shares(docs.limit(0), targets).collect()} == {0}


def test_token_counts(spark):
    df = spark.createDataFrame([(None,), ("",), ("hello world",), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(mixture.token_count(F.col("t"))).collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 1
