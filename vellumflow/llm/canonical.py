"""Freely typed values mapped to the entries of a reference list.

A multi-pattern automaton over names and aliases finds the mentions embedded in a
value, the longest non-overlapping match wins; values without one go to
token-set similarity. Both run over two writings: the value as it stands (plain
characters, no case), and a skeleton in which old and new spellings fall together.

The reference list goes to the executors as automata, in shards of at most
``MAX_NAMES`` names. Every answer carries all that it was chosen by (stage, length
and place of the match or edits, main name, rank, id), so the best answer over shards
is the one that a single list gives. Up to ``ROUND`` shards are asked in one
projection over the rows, without a shuffle, so a value that fills a third of the
rows does no harm; longer lists go over the distinct values in rounds of ``ROUND``
shards, which bounds what is broadcast and held at a time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.visual import plain, plain_form
from vellumflow.session import cut

#: Names in one automaton at most (about 50 MB in a worker).
MAX_NAMES = 50_000
#: Shards that are broadcast and asked at a time.
ROUND = 4
#: Values that one worker remembers for a shard at most.
MEMORY = 200_000

# Words that are added to a place name.
ADDITIONS = frozenset(
    "de den der het te tot in by bij naar van dorp het stad vlek gehucht en omstreken aan rivier la le les der die das the of".split()
)
# Old and variant spellings, in the order in which they are folded.
SPELLINGS = (
    ("ij", "i"), ("y", "i"), ("j", "i"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("ou", "u"),
    ("sch", "sg"), ("ph", "f"), ("gh", "g"), ("ch", "g"), ("ck", "k"), ("qu", "k"), ("c", "k"), ("th", "t"), ("dt", "t"), ("z", "s"), ("v", "w"),
)

#: No answer: (stage, two measures of the fit, main name, rank, -id).
_EMPTY = (0, 0.0, 0.0, False, 0, 1)


def words_of(value: str) -> list[str]:
    """Lower-case words of a value in plain characters; a final 's and punctuation go."""
    text = re.sub(r"['’`´]s\b", "", plain(value).casefold())
    return re.findall(r"[^\W_]+", text)


def skeleton(word: str) -> str:
    """A word with accents, doubled letters and spelling variants folded away."""
    text = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss")
    for old, new in SPELLINGS:
        text = text.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", text)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) from a to b; most + 1 if there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def grams(form: str) -> set[str]:
    """Pairs of neighbouring letters of a word, its ends marked."""
    return {f"^{form}$"[k : k + 2] for k in range(len(form) + 1)}


class _Index:
    """Forms by their letter pairs: gives those that may be within a number of edits."""

    def __init__(self, forms: list[str]):
        found: dict[str, list[int]] = defaultdict(list)
        for n, form in enumerate(forms):
            for g in grams(form):
                found[g].append(n)
        self.places = {g: np.array(n, dtype=np.int32) for g, n in found.items()}
        self.lengths = np.array([len(f) for f in forms], dtype=np.int32)

    def within(self, form: str, share: int) -> np.ndarray:
        """Forms that can be at most max(1, shorter length // share) edits away: an edit takes three pairs away at most, so none in reach is left out."""
        wanted = grams(form)
        hits = [self.places[g] for g in wanted if g in self.places]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.lengths)) if hits else np.zeros(len(self.lengths), dtype=int)
        most = np.maximum(1, np.minimum(self.lengths, len(form)) // share)
        return np.flatnonzero((shared >= len(wanted) - 3 * most) & (np.abs(self.lengths - len(form)) <= most))


class Resolver:
    """The names of one shard, ready for look-up.

    names: (id, rank, whether it is the main name, name). Of names that fit equally
    well a main name wins, then the higher rank, then the smaller id.
    """

    def __init__(self, names: list[tuple[int, int, bool, str]], edits_per: int = 5, additions: frozenset = ADDITIONS):
        import ahocorasick

        self.edits_per, self.additions = edits_per, additions
        self.exact, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        exact, folded, targets, prefixed = {}, {}, {}, {}
        for i, r, main, name in names:
            words = words_of(name)
            if not words:
                continue
            best = (bool(main), r, -i)
            skeletons = tuple(skeleton(w) for w in words)
            for table, form in ((exact, " ".join(words)), (folded, " ".join(skeletons)), (targets, (skeletons, "".join(words)))):
                if form not in table or table[form] < best:
                    table[form] = best
            form = " ".join(words)
            prefixed[form] = max(prefixed.get(form, best[1:]), best[1:])
        for automaton, table in ((self.exact, exact), (self.folded, folded)):
            for form, best in table.items():
                automaton.add_word(f" {form} ", (best, len(form)))
            automaton.make_automaton()
        # For abbreviations: the names in order, so that those with a prefix stand together.
        self.sorted = sorted(prefixed.items())
        self.targets = [("".join(parts), parts, whole, best) for (parts, whole), best in targets.items()]
        self.near_form, self.near_written = _Index([t[0] for t in self.targets]), _Index([t[2] for t in self.targets])
        self.with_word: dict[str, list[int]] = defaultdict(list)
        for n, (_, parts, *_) in enumerate(self.targets):
            for p in set(parts):
                self.with_word[p].append(n)
        self.known: dict[str, tuple] = {}

    def _embedded(self, automaton, words: list[str]) -> tuple | None:
        """The longest match (leftmost of equals) as (words' length, -end, *its entry), None if there is none."""
        if not len(automaton):
            return None
        found = [(float(n), float(-end), *best) for end, (best, n) in automaton.iter(f" {' '.join(words)} ")]
        return max(found) if found else None

    def _abbreviated(self, words: list[str]) -> tuple | None:
        start = " ".join(words)
        at, best = bisect_left(self.sorted, (start,)), None
        while at < len(self.sorted) and self.sorted[at][0].startswith(start):
            best = max(best or self.sorted[at][1], self.sorted[at][1])
            at += 1
        return best

    def similarity(self, skeletons: list[str], raw: str, n: int) -> tuple[float, float] | None:
        """(edits, edits as written), negative, between the words of a value and target n as token sets; None if they are too far apart.

        Words that both have are taken away; what is left of each, in order of the
        alphabet, may differ by one edit for every ``edits_per`` letters, and so may
        the whole texts with their words in order, folded or as written.
        """
        target, parts, whole, _ = self.targets[n]
        form = "".join(skeletons)
        most = max(1, min(len(form), len(target)) // self.edits_per)
        d = distance(form, target, most)
        if d > most:
            common = set(skeletons) & set(parts)
            if common:
                mine, theirs = ("".join(sorted(x for x in own if x not in common)) for own in (skeletons, parts))
                d = distance(mine, theirs, most)
        if d > most:
            reach = max(1, min(len(raw), len(whole)) // self.edits_per)
            if distance(raw, whole, reach) > reach:
                return None
        written = distance(raw, whole, 6)
        return -float(min(d, written)), -float(written)

    def _similar(self, words: list[str]) -> tuple | None:
        """(-edits, -edits as written, *entry) of the closest name, None if none is close."""
        skeletons, raw = [skeleton(w) for w in words], "".join(words)
        form = "".join(skeletons)
        if len(form) < 4 or not self.targets:
            return None
        near = {*self.near_form.within(form, self.edits_per).tolist(), *self.near_written.within(raw, self.edits_per).tolist()}
        for s in set(skeletons):
            near.update(self.with_word.get(s, ()))
        best = None
        for n in near:
            fit = self.similarity(skeletons, raw, n)
            if fit is not None and (best is None or (*fit, *self.targets[n][3]) > best):
                best = (*fit, *self.targets[n][3])
        return best

    def _resolve(self, value: str) -> tuple:
        """(stage, two measures of the fit, main name, rank, -entry): the larger the better; stage 0 is no answer."""
        words = words_of(value)
        if not words:
            return _EMPTY
        found = self._embedded(self.exact, words)
        if found is not None:
            return (4, *found)
        found = self._embedded(self.folded, [skeleton(w) for w in words])
        if found is not None:
            return (3, *found)
        core = words
        while core and core[0] in self.additions:
            core = core[1:]
        while core and core[-1] in self.additions:
            core = core[:-1]
        if not core:
            return _EMPTY
        if re.search(r"[^\W\d_]\.\s*$", plain(value)) and len("".join(core)) >= 4:
            found = self._abbreviated(core)
            if found is not None:
                return (2, 0.0, 0.0, False, *found)
        found = self._similar(core)
        return _EMPTY if found is None else (1, *found)

    def resolve(self, value: str) -> tuple:
        known = self.known.get(value)
        if known is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            known = self.known[value] = self._resolve(value)
        return known


_BUILT: dict[tuple, Resolver] = {}
_ANSWER = "stage int, fit double, fit2 double, main boolean, rank long, back long"


def _resolver_udf(broadcast, key: tuple, edits_per: int):
    """A pandas UDF over one shard; a worker builds the automata once and keeps those of a round."""

    @F.pandas_udf(_ANSWER)
    def resolved(values: pd.Series) -> pd.DataFrame:
        own = _BUILT.get(key)
        if own is None:
            while len(_BUILT) >= ROUND:
                del _BUILT[next(iter(_BUILT))]
            own = _BUILT[key] = Resolver(broadcast.value, edits_per)
            vars(broadcast).pop("_value", None)
        rows = [_EMPTY if v is None else own.resolve(v) for v in values]
        return pd.DataFrame(rows, columns=["stage", "fit", "fit2", "main", "rank", "back"])

    return resolved


def _shards(entries: DataFrame, max_names: int) -> Iterator[list[tuple[int, int, bool, str]]]:
    """The names of a reference list in parts of at most ``max_names``; it is read once, and the driver holds one part at a time."""
    names = entries.where(F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.col("rank").cast("long"), F.lit(0)).alias("rank"), F.posexplode(F.array_compact("names")).alias("k", "name")
    )
    own: list[tuple[int, int, bool, str]] = []
    for r in names.toLocalIterator():
        own.append((r.id, r["rank"], r.k == 0, r.name))
        if len(own) >= max_names:
            yield own
            own = []
    if own:
        yield own


def resolved(df: DataFrame, value: Column, entries: DataFrame, out: str = "entry", max_names: int = MAX_NAMES, edits_per: int = 5) -> DataFrame:
    """Add ``out``: a struct (stage, score, rank, entry) of the closest entry of a reference list.

    entries: id long (unique), rank long (breaks ties; null counts as 0), names
    array<string>, the main name first. stage is 4 for an embedded name, 3 for one
    in another spelling, 2 for an abbreviation, 1 for a similar name, and 0 (entry
    -1) if none is close or the value is null or empty; score is minus the edits of
    a similar name, else 0. An empty list gives stage 0 everywhere. Entries with a
    null id are ignored, null names skipped. The answer doesn't depend on max_names.
    """
    context = df.sparkSession.sparkContext
    none = F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(_EMPTY, (x.split() for x in _ANSWER.split(", ")))])

    def asked(column: Column, names: list) -> tuple[Column, object]:
        shared = context.broadcast(names)
        return _resolver_udf(shared, (context.applicationId, shared._jbroadcast.id(), edits_per), edits_per)(column), shared

    def finished(best: Column) -> Column:
        return F.struct(
            best["stage"].alias("stage"),
            F.when(best["stage"] == 1, best["fit"] + best["fit2"] / 10).otherwise(F.lit(0.0)).alias("score"),
            best["rank"].alias("rank"),
            (-best["back"]).alias("entry"),
        )

    shards = _shards(entries, max_names)
    first = list(islice(shards, ROUND + 1))
    if len(first) <= ROUND:
        best = [asked(value, names)[0] for names in first]
        return df.withColumn("_vf_best", F.greatest(*best) if len(best) > 1 else best[0] if best else none).withColumn(out, finished(F.col("_vf_best"))).drop("_vf_best")
    # A longer list is asked about each different value once, round by round.
    rows = df.withColumn("_vf_value", value)
    values = cut(rows.select(F.col("_vf_value").alias("_vf_v")).where("_vf_v is not null").distinct().withColumn("_vf_best", none))
    shards = chain(first, shards)
    while own := list(islice(shards, ROUND)):
        answers = [asked(F.col("_vf_v"), names) for names in own]
        values = cut(values.withColumn("_vf_best", F.greatest("_vf_best", *[a for a, _ in answers])))
        for _, shared in answers:
            shared.destroy()
    joined = rows.join(values, F.col("_vf_value") == F.col("_vf_v"), "left").withColumn(out, finished(F.coalesce("_vf_best", none)))
    return joined.drop("_vf_value", "_vf_v", "_vf_best")


def number_in(value: Column) -> Column:
    """The id that a freely written number gives: its first run of digits, with fraction and exponent; null if none."""
    text = F.regexp_extract(plain_form(value), r"(\d+(?:\.\d+)?(?:[eE][+]?\d+)?)", 1)
    return F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("long")).otherwise(text.try_cast("double").try_cast("long"))


def gazetteer_entries(gazetteer: DataFrame) -> DataFrame:
    """id, rank, names of a gazetteer: name, asciiname and the comma list of alternate names; rank is the population."""
    listed = F.filter(F.transform(F.split(F.coalesce("alternatenames", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    names = F.array_compact(F.concat(F.array(F.coalesce("name", "asciiname"), F.col("asciiname")), listed))
    return gazetteer.select(F.col("geonameid").alias("id"), F.col("population").alias("rank"), names.alias("names"))


def linked(mentions: DataFrame, gazetteer: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """mention_id, text, geonameid, how: each mention whose text isn't the very name of an entry.

    geonameid is the entry that geonames_id gives, if the gazetteer has it (how
    ``id``), else the entry whose name the text renders (``name``, ``spelling``,
    ``short``, ``similar``), else -1 (``none``). Null and empty texts resolve by
    their id or to -1. Repeated mentions give repeated rows.
    """
    names = gazetteer.where(F.col("name").isNotNull()).select(F.col("name").alias("_vf_name")).distinct()
    ids = gazetteer.select(F.col("geonameid").alias("_vf_id")).where(F.col("_vf_id").isNotNull()).distinct()
    rows = mentions.select("mention_id", "text", number_in(F.col("geonames_id")).alias("_vf_given"))
    rows = rows.join(names, F.col("text") == F.col("_vf_name"), "left_anti")
    rows = rows.join(ids, F.col("_vf_given") == F.col("_vf_id"), "left")
    rows = resolved(rows, F.when(F.col("_vf_id").isNull(), F.col("text")), gazetteer_entries(gazetteer), "_vf_r", max_names)
    how = F.array(*[F.lit(x) for x in ("none", "similar", "short", "spelling", "name")])
    return rows.select(
        "mention_id",
        "text",
        F.coalesce("_vf_id", "_vf_r.entry").cast("long").alias("geonameid"),
        F.when(F.col("_vf_id").isNotNull(), "id").otherwise(F.get(how, F.col("_vf_r.stage"))).alias("how"),
    )
