"""Candidates of mentions, their ranking and selection, and popularity of the entities linked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vellumflow.functions.ids import NOT_LINKED, is_qid
from vellumflow.functions.text import rerank_scores, selected_id
from vellumflow.operators.spans import first_by

# Names of the gazetteer's classes, of its codes, and of the states of Germany.
FEATURE_CLASSES = {
    "P": "populated place", "A": "administrative region", "H": "water feature", "L": "lake", "T": "mountain/hill", "S": "spot/building", "R": "road/railroad", "V": "forest/vegetation", "U": "undersea",
}
FEATURE_CODES = {
    "PPL": "city/town/village", "PPLA": "administrative seat", "PPLA2": "district seat", "PPLA3": "municipality seat", "PPLA4": "borough seat", "PPLC": "capital city", "PPLCH": "historical capital",
    "PPLF": "farm/village", "PPLG": "seat of government", "PPLH": "historical populated place", "PPLQ": "abandoned place", "PPLR": "religious populated place", "PPLS": "populated locality",
    "PPLW": "destroyed place", "PPLX": "section of populated place", "ST": "stream", "STM": "stream", "STMI": "intermittent stream", "STMR": "meandering stream", "STMSB": "stream bend", "LK": "lake",
    "LKI": "intermittent lake", "LKN": "salt lake", "RSV": "reservoir", "RSVT": "water tank", "CNL": "canal", "DTCH": "ditch", "MT": "mountain", "MTT": "mountain range", "HLL": "hill", "HLLS": "hills",
    "PK": "peak", "RK": "rock", "VLC": "volcano", "VAL": "valley", "PLN": "plain", "FLD": "field", "FRM": "farm", "CH": "church", "CHS": "church (historical)", "MNA": "monastery", "MN": "mine",
    "MUS": "museum", "HTL": "hotel", "INN": "inn", "CAST": "castle", "PAL": "palace", "FT": "fort", "BTL": "battlefield", "PARK": "park", "GDN": "garden", "SQ": "square", "BRDG": "bridge",
    "RSTN": "railroad station", "RSTP": "railroad stop", "BD": "border post", "PRK": "parking area", "PYR": "pyramid", "TOWR": "tower", "MNMT": "monument", "FCL": "facility", "HSP": "hospital",
    "SCH": "school", "UNIV": "university", "THTR": "theater", "LCTY": "locality", "AREA": "area", "RG": "region", "RGN": "region", "ISL": "island", "PEN": "peninsula", "PT": "point", "BAY": "bay",
    "GULF": "gulf", "STRT": "strait", "CHN": "channel", "HBR": "harbor", "BCH": "beach", "CLF": "cliff", "CAPE": "cape", "FRST": "forest", "PRT": "port", "RUIN": "ruin", "SHRN": "shrine", "WLL": "well",
    "SPNG": "spring", "FLLS": "waterfall", "GLCR": "glacier", "DAM": "dam", "PIER": "pier", "WHF": "wharf", "LTHSE": "lighthouse", "AIRP": "airport", "CMP": "camp", "CSTL": "castle",
}
STATES_DE = {
    "01": "Baden-Württemberg", "02": "Bayern", "03": "Bremen", "04": "Hamburg", "05": "Hessen", "06": "Niedersachsen", "07": "Nordrhein-Westfalen", "08": "Rheinland-Pfalz", "09": "Saarland",
    "10": "Schleswig-Holstein", "11": "Brandenburg", "12": "Mecklenburg-Vorpommern", "13": "Sachsen", "14": "Sachsen-Anhalt", "15": "Thüringen", "16": "Berlin",
}


def popularity(dump: DataFrame, entity: str = "entity", score: str = "qrank") -> DataFrame:
    """The dump with ``rank``: place by falling score, equals by entity.

    Places over the whole dump are counted by (score, entity) ranges: a range's own
    places plus the sizes of the ranges before it, so no task sorts all rows.
    """
    parts = dump.repartitionByRange(F.desc(score), F.asc(entity)).withColumn("_vf_part", F.spark_partition_id())
    from vellumflow.session import cut

    parts = cut(parts)
    before = Window.orderBy("_vf_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    sizes = parts.groupBy(F.col("_vf_part").alias("_vf_p")).count().withColumn("_vf_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("_vf_part").orderBy(F.desc(score), F.asc(entity))
    return parts.withColumn("_vf_n", F.row_number().over(inside)).join(F.broadcast(sizes), F.col("_vf_part") == F.col("_vf_p")).withColumn("rank", F.col("_vf_n") + F.col("_vf_before")).select(*dump.columns, "rank")


def in_dump(mentions: DataFrame, dump: DataFrame, qid: str = "wikidata_qid") -> DataFrame:
    """Mentions with ``dump_qrank`` and ``found``: a left join on the dump's entity."""
    known = dump.select(F.col("entity").alias("_vf_e"), F.col("qrank").alias("dump_qrank"))
    return mentions.join(known, F.col(qid) == F.col("_vf_e"), "left").withColumn("found", F.col("_vf_e").isNotNull()).drop("_vf_e")


def sampled(ranked: DataFrame, n: int = 3000, decades: float = 7.5, rank: str = "rank") -> DataFrame:
    """Rows of a ranking at n ranks that are spread evenly on a logarithmic scale, from 1 to 10^decades; ranks that fall together stand once."""
    spark = ranked.sparkSession
    targets = spark.range(n).select(F.bround(F.pow(F.lit(10.0), F.col("id") * F.lit(decades / max(n - 1, 1)))).cast("long").alias("_vf_t")).distinct()
    return ranked.join(targets, F.col(rank) == F.col("_vf_t"), "left_semi")


def per_entity(mentions: DataFrame) -> DataFrame:
    """wikidata_qid, text, label, qrank, n_mentions, in_qrank of linked mentions."""
    linked = mentions.where(is_qid(F.col("wikidata_qid")))
    return linked.groupBy("wikidata_qid", "text", "label").agg(F.max("qrank").alias("qrank"), F.count(F.lit(1)).alias("n_mentions"), F.bool_or("in_qrank").alias("in_qrank"))


def popularity_bucket(score: Column) -> Column:
    """Buckets by powers of ten; null, zero and negative scores are not in the dump."""
    return (
        F.when(score.isNull() | (score <= 0), "tail (not in QRank)").when(score < 10_000, "tail (<1e4)").when(score < 100_000, "mid  (1e4-1e5)").when(score < 1_000_000, "mid  (1e5-1e6)")
        .when(score < 10_000_000, "head (1e6-1e7)").otherwise("head (>=1e7)")
    )


def described(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, n, mean, std, min, p25, median, p75, max (percentiles interpolated)."""
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("p25"), F.median(c).alias("median"), F.percentile(c, 0.75).alias("p75"), F.max(c).alias("max")
    )


def coverage(mentions: DataFrame, by: list[str], wd: str, gn: str) -> DataFrame:
    """by, kb (both, wikidata, geonames, none), n: the four disjoint parts, empty ones left out."""
    from vellumflow.functions.ids import has_id

    w, g = has_id(F.col(wd)), has_id(F.col(gn))
    kb = F.when(w & g, "both").when(w, "wikidata").when(g, "geonames").otherwise("none")
    return mentions.groupBy(*by, kb.alias("kb")).agg(F.count(F.lit(1)).alias("n"))


def description(gazetteer: DataFrame) -> DataFrame:
    """Gazetteer with ``description``: name, (class — code), German state, country and population, those that are there."""
    from vellumflow.functions.ids import mapped

    known = lambda c: F.when(F.trim(c) != "", c)
    kind = F.nullif(F.concat_ws(" — ", mapped(F.col("feature_class"), FEATURE_CLASSES), mapped(F.col("feature_code"), FEATURE_CODES)), F.lit(""))
    state = F.when(F.col("country_code") == "DE", mapped(F.col("admin1_code"), STATES_DE))
    people = F.when(F.col("population") > 0, F.concat(F.lit("pop. "), F.col("population").cast("string")))
    return gazetteer.withColumn("description", F.concat_ws(", ", known(F.coalesce("name", "asciiname")), F.concat(F.lit("("), kind, F.lit(")")), state, known(F.col("country_code")), people))


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | (1 << k)
    return out


def _common(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence, all rows of a column in the bits of one number."""
    whole = (1 << size) - 1
    state = whole
    for c in other:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & whole
    return size - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 by insertions and deletions: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    return 200.0 * _common(_masks(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ``indel_ratio`` of the shorter text against any stretch of the longer one of its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    masks, best = _masks(short), 0.0
    for k in range(1 - len(short), len(long)):
        part = long[max(0, k) : k + len(short)]
        best = max(best, 200.0 * _common(masks, len(short), part) / (len(short) + len(part)))
    return best


@F.pandas_udf(DoubleType())
def name_similarity(mentions: pd.Series, names: pd.Series) -> pd.Series:
    """Better of the whole and the partial ratio, case ignored; null where one is null."""
    seen: dict[tuple, float] = {}

    def one(a, b):
        if a is None or b is None:
            return None
        if (a, b) not in seen:
            seen[a, b] = max(indel_ratio(a.lower(), b.lower()), partial_ratio(a.lower(), b.lower()))
        return seen[a, b]

    return pd.Series([one(a, b) for a, b in zip(mentions, names)], dtype="float64")


def _grams(text: Column, n: int = 3) -> Column:
    plain = F.lower(text)
    ends = F.greatest(F.length(plain) - n + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), ends), lambda k: F.substring(plain, k, F.lit(n))))


def _blocking(size: int, least: float) -> tuple[int, int]:
    """(length of grams, grams lost at most) of the shorter text of a pair whose similarity is ``least`` or more.

    With d characters of it left out and i put in, 2 * (size - d) / (2 * size - d + i)
    has to reach the ratio r, so d * (2 - r) + i * r <= 2 * (1 - r) * size. A
    character left out takes n grams, one put in n - 1. The longest grams are taken of
    which one has to stay.
    """
    r = least / 100
    room = 2 * (1 - r) * size + 1e-9
    for n in (3, 2, 1):
        lost = max(n * d + (n - 1) * int(min((room - d * (2 - r)) / r, 2 * size)) for d in range(int(room / (2 - r)) + 1))
        if n == 1 or lost < size - n + 1:
            return n, lost
    raise AssertionError


#: Letters that make up most of a western text, by which rare grams are told from frequent ones.
_COMMON = "enatirodslhg "


def _alike(texts: DataFrame, names: DataFrame, least: float, longest: int = 256) -> DataFrame:
    """t, geonameid, form: every pair whose whole or partial ratio may reach ``least``.

    The shorter one gives as many grams as can be lost and one more; at least one of
    them is among the grams of the longer one. The pairs that meet are then held to
    the number of grams shared. Texts over ``longest`` characters are told by the
    bound of that length, which is a larger share.
    """
    table = [_blocking(k, least) for k in range(1, longest + 1)]
    size = F.length(F.lower("x"))
    at = F.least(F.greatest(size, F.lit(1)), F.lit(longest))
    length = F.element_at(F.array(*[F.lit(n) for n, _ in table]), at)
    lost = F.when(size <= longest, F.element_at(F.array(*[F.lit(k) for _, k in table]), at)).otherwise(F.ceil(F.lit((table[-1][1] + 1) / longest) * size)).cast("int")
    of = lambda n: _grams(F.col("x"), n)
    by_length = F.when(length == 3, of(3)).when(length == 2, of(2)).otherwise(of(1))
    name = names.withColumnRenamed("form", "x")
    text = texts.withColumnRenamed("t", "x")

    def short(rows: DataFrame) -> DataFrame:
        # Any of the grams will do, so those with few of the commonest letters are taken: they meet the fewest names.
        rare = F.transform(F.array_sort(F.transform(by_length, lambda g: F.struct((-F.length(F.translate(g, _COMMON, ""))).alias("k"), g.alias("g")))), lambda x: x["g"])
        kept = rows.withColumns({"size": size, "own": rare, "lost": lost}).withColumn("need", F.greatest(F.size("own") - F.col("lost"), F.lit(1)))
        return kept.withColumn("g", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)))

    # Grams of one letter only answer texts so short that they ask for them.
    def long(rows: DataFrame, others: DataFrame) -> DataFrame:
        asks = others.where(length == 1).limit(1).count() > 0
        return rows.withColumns({"size": size, "all": F.array_union(F.array_union(of(3), of(2)), of(1) if asks else F.array().cast("array<string>"))}).withColumn("g", F.explode("all"))

    def met(a: DataFrame, b: DataFrame, t: str, form: str, sizes: Column) -> DataFrame:
        own = [F.col("b.geonameid")] if form == "b" else [F.col("a.geonameid")]
        pairs = a.alias("a").join(b.alias("b"), (F.col("a.g") == F.col("b.g")) & sizes)
        pairs = pairs.where(F.size(F.array_intersect("a.own", "b.all")) >= F.col("a.need"))
        return pairs.select(F.col(f"{t}.x").alias("t"), *own, F.col(f"{form}.x").alias("form"))

    one = met(short(text), long(name, text), "a", "b", F.col("a.size") <= F.col("b.size"))
    other = met(short(name), long(text, name), "b", "a", F.col("a.size") < F.col("b.size"))
    return one.unionByName(other).distinct()


def gazetteer_search(mentions: DataFrame, gazetteer: DataFrame, key: str = "mention_key", text: str = "text", least: float = 85.0, top: int = 10) -> DataFrame:
    """key, geonameid, name, score, pos: the gazetteer entries whose name is like a mention's text.

    Distinct texts only. Candidates are found by an equi join on grams in place of
    every pair: the shorter of text and name shares at least as many with the longer
    one as ``least`` implies (``_blocking``), so no pair of that score is left out.
    Score: name similarity; ten more if one holds the other, up to twenty by
    population, five for populated places, three for waters and areas; never over 100.
    """
    listed = F.filter(F.transform(F.split(F.coalesce("alternatenames", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    names = gazetteer.select("geonameid", "name", "population", "feature_class", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name", "asciiname"), listed)))).alias("form"))
    texts = mentions.where(F.trim(F.col(text)) != "").select(F.col(text).alias("t")).distinct()
    shared = _alike(texts, names.select("geonameid", "form"), least)
    # Few bytes but much work by row: keep all partitions, which coalescing by bytes would merge.
    shared = shared.repartition(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "geonameid", "form")
    # Nondeterministic by name only: else the filter is pushed below the partitions and the distinct pairs.
    similar = F.pandas_udf(name_similarity.func, DoubleType()).asNondeterministic()
    scored = shared.withColumn("s", similar("t", "form")).where(F.col("s") >= least).groupBy("t", "geonameid").agg(F.max("s").alias("s"))
    everything = F.lower(F.concat_ws(" ", "name", "asciiname", F.array_join(listed, " "))).alias("everything")
    info = gazetteer.select("geonameid", "name", F.coalesce("population", F.lit(0)).alias("population"), "feature_class", everything)
    full = scored.join(info, "geonameid")
    low = F.lower("t")
    bonus = F.when(F.contains(F.col("everything"), low) | F.contains(low, F.col("everything")), 10).otherwise(0)
    s = F.least(F.lit(100.0), F.col("s") + bonus)
    s = F.least(F.lit(100.0), s + F.least(F.lit(20.0), F.col("population") / 10_000))
    s = F.least(F.lit(100.0), s + F.when(F.col("feature_class") == "P", 5).when(F.col("feature_class").isin("H", "L"), 3).otherwise(0))
    ranked = full.withColumn("score", s).withColumn("pos", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "geonameid"))).where(F.col("pos") <= top)
    own = mentions.select(key, F.col(text).alias("_vf_t"))
    return own.join(ranked, F.col("_vf_t") == F.col("t")).select(key, "geonameid", "name", "score", "pos")


def eligible(mentions: DataFrame, label: str = "label") -> DataFrame:
    """Mentions whose label is linked at all."""
    return mentions.where(F.coalesce(~F.col(label).isin(*NOT_LINKED), F.lit(True)))


def merged_lanes(lanes: list[DataFrame], key: str = "mention_key") -> DataFrame:
    """Candidates of several lanes (key, kb, id, pos, ...) in lane order, the first of each (key, kb, id), with a new ``pos``."""
    together = None
    for k, lane in enumerate(lanes):
        rows = lane.withColumn("lane", F.lit(k))
        together = rows if together is None else together.unionByName(rows, allowMissingColumns=True)
    kept = first_by(together, [key, "kb", "id"], ["lane", "pos"])
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(key, "kb").orderBy("lane", "pos", "id")))


def reranked(candidates: DataFrame, answers: DataFrame, top: int = 3, key: str = "mention_key") -> DataFrame:
    """The best candidates of each (key, kb) by the scores of an answer; stable for equals. A single candidate has score 1.0 without one.

    answers: key, kb, answer.
    """
    group = Window.partitionBy(key, "kb")
    listed = candidates.withColumn("_vf_n", F.count(F.lit(1)).over(group)).withColumn("_vf_k", F.row_number().over(group.orderBy("pos")))
    said = listed.join(answers, [key, "kb"], "left")
    score = F.when(F.col("_vf_n") <= 1, F.lit(1.0)).otherwise(F.get(rerank_scores(F.col("answer"), F.col("_vf_n").cast("int")), F.col("_vf_k") - 1))
    ranked = said.withColumn("rerank_score", score).withColumn("_vf_r", F.row_number().over(group.orderBy(F.desc("rerank_score"), "pos")))
    return ranked.where(F.col("_vf_r") <= top).select(*candidates.columns, "rerank_score", F.col("_vf_r").alias("rank"))


def selected(candidates: DataFrame, answers: DataFrame, key: str = "mention_key") -> DataFrame:
    """key, kb, id: what an answer selects among the candidates; null (NIL) without candidates or answer."""
    lists = candidates.groupBy(key, "kb").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    both = lists.join(answers, [key, "kb"], "full")
    return both.select(key, "kb", F.when(F.size("ids") > 0, selected_id(F.col("answer"), F.col("ids"))).alias("id"))


def enriched(candidates: DataFrame, extracts: DataFrame, words: int = 300) -> DataFrame:
    """Candidates with ``wikipedia_extract`` of their id: the first words of the text, dots if there are more; other ids stay null."""
    parts = F.split(F.trim("extract"), r"\s+")
    short = F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(F.col("extract"))
    known = extracts.select(F.col("id").alias("_vf_id"), short.alias("wikipedia_extract"))
    return candidates.join(known, (F.col("id") == F.col("_vf_id")) & is_qid(F.col("id")), "left").drop("_vf_id")


def resolved_titles(hits: DataFrame, pages: DataFrame, key: str = "mention_key") -> DataFrame:
    """Search hits (key, pos, title) with the QID of their page; pages without one (page_id -1 or null qid) are dropped, order kept."""
    known = pages.where("page_id <> -1 and qid is not null").select(F.col("title").alias("_vf_t"), "qid")
    return hits.join(known, F.col("title") == F.col("_vf_t")).drop("_vf_t")


def once_for_each(mentions: DataFrame, keys: list[str], context: str, order: str) -> DataFrame:
    """One row for each key with the context of its first mention: what an external lane is asked once and joined back."""
    return mentions.groupBy(*keys).agg(F.min_by(context, order).alias(context), F.min(order).alias("first"), F.count(F.lit(1)).alias("n_mentions"))
