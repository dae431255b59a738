"""Sources mixed to target shares of a total size in tokens.

Every document has a hash. Tokens are summed by source and hash bucket; the running
sum over the buckets shows in which one a source's budget ends, and only that bucket
is summed again by finer hash bits, until the threshold is exact. The selection is a
filter on the hash: nothing is sorted, no document moves, and larger budgets select
supersets of smaller ones, so all mixes share the histograms.

A budget above a source's size is met by whole repeats (at most ``max_repeats`` in
all) and a part chosen by threshold.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import cut, spread

#: Vocabulary of the public tokenizer that sizes are counted with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash, in three levels.
#: Rows of the plan (a mix and a source each) that are broadcast at most; more are joined by a shuffle.
MAX_OPEN = 100_000
BITS = (12, 12, 24)
# How the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("vellumflow", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty texts. Strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(vocabulary)
        filled = [t if t else "" for t in texts]
        return pd.Series([len(x) for x in encoding.encode_ordinary_batch(filled, num_threads=1)], dtype="int64")

    return count(text)


def source_name(source: Column) -> Column:
    """A source without the variants of its spelling: trimmed, lower-case; empty becomes null."""
    plain = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return F.when(plain != "", plain)


def sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, h: each document with a source, its size and its place in the order of hashes."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id)).bitwiseAND(F.lit((1 << sum(BITS)) - 1))
    rows = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("_vf_t"), h.alias("h"))
    return spread(rows.where("source is not null"), "doc_id").select("doc_id", "source", token_count(F.col("_vf_t"), vocabulary).alias("n_tokens"), "h")


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, available, budget, repeats, rest: what each source is to give.

    total_tokens: size of a mix; null means the largest at which every source that
    has documents can give its share within its repeats. Sources without documents
    give nothing; the shares of the others keep their proportions. Repeated rows of
    a mix and source add up their shares; null or negative shares count as 0, null
    repeats as 1.
    """
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r"))
    wanted = wanted.where("source is not null").groupBy("mix_name", "source").agg(F.sum("w").alias("target_share"), F.min("r").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("available")).withColumnRenamed("source", "_vf_s")
    rows = wanted.join(held, F.col("source") == F.col("_vf_s"), "left").drop("_vf_s").withColumn("available", F.coalesce("available", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    most = F.col("available") * F.col("max_repeats")
    possible = (most > 0) & (F.col("target_share") > 0)
    share = F.when(possible, F.col("target_share")) / F.sum(F.when(possible, F.col("target_share"))).over(mix)
    rows = rows.withColumn("_vf_w", F.coalesce(share, F.lit(0.0)))
    largest = F.min(F.when(F.col("_vf_w") > 0, F.col("available") * F.col("max_repeats") / F.col("_vf_w"))).over(mix)
    total = largest if total_tokens is None else F.least(F.lit(float(total_tokens)), largest)
    rows = rows.withColumn("budget", F.coalesce(F.floor(total * F.col("_vf_w") + 1e-6), F.lit(0)))
    rows = rows.withColumn("budget", F.least("budget", most))
    repeats = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("repeats", repeats).withColumn("rest", F.col("budget") - F.col("repeats") * F.col("available")).drop("_vf_w")


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``threshold``: documents with h below it come once more. -1 where nothing is left over."""
    keys = ["mix_name", "source"]
    high, low = BITS[1] + BITS[2], BITS[2]
    levels = [
        F.shiftright("h", high),
        F.shiftright("h", low).bitwiseAND(F.lit((1 << BITS[1]) - 1)),
        F.col("h").bitwiseAND(F.lit((1 << low) - 1)),
    ]
    open_ = wanted.where("rest > 0").select(*keys, F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    shift = sum(BITS)
    for level, bucket in enumerate(levels):
        shift -= BITS[level]
        inside = sized.select(F.col("source").alias("_vf_s"), bucket.alias("b"), "n_tokens", F.shiftright("h", shift + BITS[level]).alias("_vf_p"))
        if level == 0:
            # One histogram of all sources serves every mix.
            histogram = inside.groupBy("_vf_s", "b").agg(F.sum("n_tokens").alias("n"))
            joined = open_.join(histogram, F.col("source") == F.col("_vf_s"))
        else:
            small = open_.count() <= MAX_OPEN
            joined = inside.join(F.broadcast(open_) if small else open_, (F.col("source") == F.col("_vf_s")) & (F.col("prefix") == F.col("_vf_p")))
            joined = joined.groupBy(*keys, "left", "prefix", "b").agg(F.sum("n_tokens").alias("n"))
        run = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        before = joined.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        # The bucket in which the budget ends: the last that begins within it.
        ends = before.where(F.col("before") <= F.col("left")).groupBy(*keys).agg(F.max_by(F.struct("b", "before", "n", "left", "prefix"), "b").alias("e"))
        open_ = cut(
            ends.select(
                *keys,
                (F.col("e.left") - F.col("e.before")).alias("left"),
                (F.shiftleft(F.col("e.prefix"), BITS[level]) + F.col("e.b")).alias("prefix"),
                F.col("e.n").alias("n"),
            )
        )
    # The document in which the budget ends is taken only if it fits, so no budget is exceeded.
    exact = open_.select(F.col("mix_name").alias("_vf_m"), F.col("source").alias("_vf_s"), (F.col("prefix") + (F.col("left") >= F.col("n")).cast("int")).alias("threshold"))
    joined = wanted.join(exact, (F.col("mix_name").eqNullSafe(F.col("_vf_m"))) & (F.col("source") == F.col("_vf_s")), "left")
    return joined.select(*wanted.columns, F.coalesce("threshold", F.lit(-1)).alias("threshold"))


def _plan(documents: DataFrame, targets: DataFrame, total_tokens: int | None, parameters: dict) -> tuple[DataFrame, DataFrame]:
    sized = cut(sizes(documents, **parameters))
    return sized, cut(thresholds(sized, cut(budgets(sized, targets, total_tokens))))


def _selected(sized: DataFrame, plan: DataFrame) -> DataFrame:
    # The plan has a row for each mix and source; Spark broadcasts it if it is small.
    rows = sized.withColumnRenamed("source", "_vf_s").join(plan, F.col("_vf_s") == F.col("source"))
    copies = F.col("repeats") + (F.col("h") < F.col("threshold")).cast("int")
    return rows.select("mix_name", "doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def selection(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, **parameters) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, copies: how often each document is used in each mix (1 or more).

    Documents without a source, or of a source in no mix, are in none. Documents with
    equal ids have equal hashes and are taken together. The document in which a
    budget ends is left out if it goes beyond it, so no budget is exceeded and a
    source stays below it by less than one document. An empty table gives an empty
    selection.
    """
    return _selected(*_plan(documents, targets, total_tokens, parameters))


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, **parameters) -> DataFrame:
    """mix_name, source, target_share, max_repeats, available, budget, n_documents, most_copies, n_tokens, actual_share."""
    sized, plan = _plan(documents, targets, total_tokens, parameters)
    used = _selected(sized, plan).groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens")
    ).select(F.col("mix_name").alias("_vf_m"), F.col("source").alias("_vf_s"), "n_documents", "most_copies", "n_tokens")
    rows = plan.join(used, F.col("mix_name").eqNullSafe(F.col("_vf_m")) & (F.col("source") == F.col("_vf_s")), "left")
    rows = rows.select("mix_name", "source", "target_share", "max_repeats", "available", "budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "most_copies", "n_tokens")])
    total = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)))
