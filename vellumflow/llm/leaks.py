"""Evaluation passages that stand, wholly or partly, in training documents.

The documents of a partition are cut into shards of at most ``SHARD_WORDS`` words.
A shard gets a full suffix array over all its words in folded spelling, whatever the
items hold: the suffixes are sorted by their first words and then by ranks of doubled
depth until no two are equal. Every suffix of the evaluation items is binary-searched
in it, word by word, which gives the interval of places for each length and so the
longest verbatim match with every place. Only matches that can't be lengthened to the
left are kept. Matches of a document and an item that follow each other, with small
gaps, chain to one connected passage, and its length in item words decides.

The evaluation items are the query set; they go to the executors in blocks of at
most ``BLOCK_WORDS`` words, which a shard is held against one after the other. The
documents are read once and never shuffled by their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.canonical import distance, skeleton
from vellumflow.llm.visual import plain
from vellumflow.session import spread

SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
#: Pairs of places that are held in memory at a time.
PAIRS = 4_000_000
#: Words of a verbatim match at least.
SEED = 2
#: Words of an item, or of the document, that may stand between two matches of a passage.
GAP = 8
#: Part of an item's words that a passage has to hold.
PART = 0.5
#: Different written words that a worker remembers at most.
MEMORY = 1_000_000

_JOIN = re.compile(r"(?<=[^\W\d_])[-¬=⸗­][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
# What a line may end with before such a break is looked at more closely.
_BREAKS = frozenset("-¬=⸗­ \t\r")
_WORD = re.compile(r"[^\W_]+")
# A character that may have another plain form.
_UNUSUAL = re.compile(r"[^\s -~¡-žƀ–-‡…‹›€]")


class Vocabulary(dict):
    """Numbers (from 0) of written words; words of one folded spelling have one number."""

    def __init__(self):
        super().__init__()
        self.folded: dict[str, int] = {}
        self.names: list[str] = []

    def __missing__(self, word: str) -> int:
        form = skeleton(word)
        number = self.folded.get(form)
        if number is None:
            number = self.folded[form] = len(self.names)
            self.names.append(form)
        self[word] = number
        return number


def written_words(text: str) -> list[str]:
    """Lower-case words of a text; words broken at a line's end are joined."""
    if _UNUSUAL.search(text):
        text = "\n".join(plain(line) for line in text.split("\n"))
    if any(line[-1:] in _BREAKS for line in text.split("\n")):
        text = _JOIN.sub("", text)
    return _WORD.findall(text.lower())


def folded_words(text: str) -> list[str]:
    """Words of a text, lower-case, without accents and spelling variants; words broken at a line's end are joined."""
    return [skeleton(w) for w in written_words(text)]


class Items:
    """The suffixes of a block of evaluation items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [folded_words(t or "") for _, t in items]
        self.sizes = np.array([len(p) for p in self.words], dtype=np.int64)
        self.item = np.repeat(np.arange(len(self.words), dtype=np.int32), self.sizes)
        self.at = np.concatenate([np.arange(n, dtype=np.int32) for n in self.sizes]) if len(self.words) else np.zeros(0, np.int32)
        self.ends = np.repeat(np.cumsum(self.sizes), self.sizes)

    def tokens(self, vocabulary: Vocabulary) -> np.ndarray:
        """The words' numbers in a vocabulary, -1 where it has none."""
        return np.array([vocabulary.folded.get(w, -1) for p in self.words for w in p], dtype=np.int64)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order. Every document has to end in a number of its own, so no two suffixes are equal."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ids = tokens - tokens.min() + 1
    base, known = int(ids.max()) + 1, 1
    key = ids
    # As many first words as go into one number are compared at once.
    while known < 4 and int(key.max()) < (1 << 62) // base:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-known] = ids[known:]
        key = key * base + ahead
        known += 1
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    slots, key = np.arange(n), key[order]
    place = order
    while True:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        rank[place] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        place = order[slots]
        ahead = place + known
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[place] * (n + 1) + following
        own = np.argsort(key)
        key, place = key[own], place[own]
        order[slots] = place
        known *= 2


def _narrowed(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the intervals [low, high) of a suffix array whose word at ``depth`` is the wanted one, by binary search."""
    n = len(tokens)

    def bound(after: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            at = order[middle] + depth
            there = tokens[np.minimum(at, n - 1)]
            right = there <= wanted[open_] if after else there < wanted[open_]
            a[open_] = np.where(right, middle + 1, a[open_])
            b[open_] = np.where(right, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        return a

    return bound(False), bound(True)


def longest_matches(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray, ends: np.ndarray, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in tokens, place in wanted, words) of the verbatim matches of ``seed`` words or more that go on neither to the left nor to the right.

    tokens, order: a shard and its suffix array; wanted: the items' words one after
    the other, -1 for unknown ones; ends: where the item of each word ends. Comes in
    parts of about ``PAIRS`` pairs, a part holds whole items.
    """
    m = len(wanted)
    suffix = np.flatnonzero(wanted >= 0)
    low, high = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(tokens), dtype=np.int64)
    depth = 0
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # intervals that a longer match leaves over
    while len(suffix):
        inside = (suffix + depth < ends[suffix]) & (wanted[np.minimum(suffix + depth, m - 1)] >= 0)
        a, b = high.copy(), high.copy()
        if inside.any():
            a[inside], b[inside] = _narrowed(tokens, order, low[inside], high[inside], depth, wanted[suffix[inside] + depth])
        if depth >= seed:
            # What stands left and right of the narrower interval matches for exactly this length.
            levels += [(suffix, low, a, depth), (suffix, b, high, depth)]
        on = a < b
        suffix, low, high = suffix[on], a[on], b[on]
        depth += 1
    if not levels:
        return
    suffix, low, high = (np.concatenate([x[k] for x in levels]) for k in range(3))
    words = np.concatenate([np.full(len(x[0]), x[3], dtype=np.int32) for x in levels])
    own = np.flatnonzero(low < high)
    own = own[np.argsort(suffix[own], kind="stable")]
    suffix, low, words, count = suffix[own], low[own], words[own], (high - low)[own]
    border = np.flatnonzero(np.r_[True, ends[suffix[1:]] != ends[suffix[:-1]]]) if len(own) else np.zeros(0, int)
    totals = np.cumsum(count)
    before, wanted_before = np.r_[-1, tokens[:-1]], np.r_[-1, wanted[:-1]]
    wanted_before[np.r_[True, ends[1:] != ends[:-1]]] = -1
    before[before < 0] = -2  # the start of a document agrees with nothing
    first = 0
    while first < len(own):
        # As many whole items as fit, one at least.
        limit = (totals[first - 1] if first else 0) + PAIRS
        later = border[border > first]
        fits = later[totals[later - 1] <= limit]
        if not len(later) or len(fits) == len(later) and totals[-1] <= limit:
            last = len(own)
        else:
            last = int(fits[-1] if len(fits) else later[0])
        c, s = count[first:last], suffix[first:last]
        slot = np.repeat(low[first:last] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        place, where, length = order[slot], np.repeat(s, c), np.repeat(words[first:last], c)
        # A match whose words before agree as well is a part of a longer one.
        keep = np.flatnonzero(before[place] != wanted_before[where])
        yield place[keep].astype(np.int32), where[keep], length[keep]
        first = last


@lru_cache(100_000)
def _near(a: str, b: str) -> bool:
    most = max(1, len(a) // 4)
    return a == b or len(a) > 3 and distance(a, b, most) <= most


def _between(item: list[str], doc: list[str]) -> tuple[int, int]:
    """(words that agree, words held) of a gap: words in slightly other form in their place, from both ends; a wrong word counts as held if its neighbours agree."""
    n = min(len(item), len(doc))
    if not n:
        return 0, 0
    if len(item) == len(doc):
        fits = [True, *(_near(a, b) for a, b in zip(item, doc)), True]
        agree = sum(fits[1:-1])
        return agree, agree + sum(fits[k - 1] and not fits[k] and fits[k + 1] for k in range(1, n + 1))
    left = 0
    while left < n and _near(item[left], doc[left]):
        left += 1
    right = 0
    while right < n - left and _near(item[-1 - right], doc[-1 - right]):
        right += 1
    return left + right, left + right


def _passage(runs: np.ndarray, item: list[str], doc: list[str]) -> tuple[int, int]:
    """(words that agree, words held) of the passage that holds most words of an item.

    runs: (place in item, place in doc, words) of verbatim matches. A chain goes
    forward in both with gaps of at most GAP words; the ends grow by up to GAP words
    in a slightly other form.
    """
    runs = runs[np.lexsort((runs[:, 0], runs[:, 1]))].tolist()
    best: list[tuple[int, int]] = []
    back = [-1] * len(runs)
    open_ = 0
    longest = 0
    for i, (p, d, n) in enumerate(runs):
        own, longest = (n, n), max(longest, n)
        # Runs are in order of their start, so those that end too far back are passed for good.
        while open_ < i and runs[open_][1] + longest + GAP < d:
            open_ += 1
        for j in range(i - 1, open_ - 1, -1):
            q, e, m = runs[j]
            over, gap = p - q - m, d - e - m
            if over > GAP or gap > GAP or p <= q or d <= e or abs(over - gap) > GAP:
                continue
            cut = max(0, -over, -gap)
            if cut >= n:
                continue
            a, b = best[j]
            if b + n - cut + GAP <= own[1]:
                continue
            agree, held = _between(item[q + m : p], doc[e + m : d]) if over > 0 and gap > 0 else (0, 0)
            if (b + n - cut + held, a + n - cut + agree) > (own[1], own[0]):
                own, back[i] = (a + n - cut + agree, b + n - cut + held), j
        best.append(own)
    end = max(range(len(best)), key=lambda i: (best[i][1], best[i][0]))
    start = end
    while back[start] >= 0:
        start = back[start]

    def grown(p: int, d: int, way: int) -> tuple[int, int]:
        agree = held = missed = 0
        for _ in range(GAP):
            if missed > 1 or not (0 <= p < len(item) and 0 <= d < len(doc)):
                break
            if _near(item[p], doc[d]):
                agree, held, missed = agree + 1, held + 1 + missed, 0
            else:
                missed += 1
            p, d = p + way, d + way
        return agree, held

    (a, b), (p, d, n) = best[end], runs[end]
    x, y = grown(p + n, d + n, 1)
    p, d, _ = runs[start]
    v, w = grown(p - 1, d - 1, -1)
    return a + x + v, b + y + w


def _parted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a new group begins there): groups split where more than GAP lies between the ends so far and the next start."""
    start, end = start - int(start.min()), end - int(start.min())
    room = int(end.max()) + GAP + 2
    order = np.argsort(group * room + start)
    group, start, end = group[order], start[order], end[order]
    new = np.r_[True, group[1:] != group[:-1]]
    lane = (np.cumsum(new) - 1) * room
    furthest = np.maximum.accumulate(lane + end) - lane
    return order, new | np.r_[True, start[1:] > furthest[:-1] + GAP]


def _chains(doc: np.ndarray, item: np.ndarray, p: np.ndarray, d: np.ndarray, n: np.ndarray, need: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of matches of one document and item that may form a passage of as many words as ``need`` says of the item.

    A step of a passage leaves out at most GAP words of the document and of the item
    and moves by at most GAP words against each other, so matches further apart fall
    into different groups. A group is left out only if its matches with GAP words for
    every gap and end, or the stretch they take in the document or in the item, hold
    too few words: no passage is lost.
    """
    group, own = doc.astype(np.int64) * len(need) + item, np.arange(len(doc), dtype=np.int32)
    for k in range(6):
        at = (d, p - d, p)[k % 3]
        order, new = _parted(group, at, at if k % 3 == 1 else at + n)
        p, d, n, item = p[order], d[order], n[order], item[order]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(order)])
        held = np.add.reduceat(n, starts) + (sizes + 1) * GAP
        for x in (d, p):
            held = np.minimum(held, np.maximum.reduceat(x + n, starts) - np.minimum.reduceat(x, starts) + 2 * GAP)
        enough = held >= need[item[starts]]
        keep = np.repeat(enough, sizes)
        group = np.repeat(np.arange(int(enough.sum())), sizes[enough])
        own, p, d, n, item = own[order[keep]], p[keep], d[keep], n[keep], item[keep]
        if not len(own):
            return
    yield from np.split(own, np.flatnonzero(np.diff(group)) + 1)


def leaks_of(docs: list[tuple[int, str | None]], blocks: Iterator[Items], part: float = PART, seed: int = SEED, vocabulary: Vocabulary | None = None) -> list[tuple[int, int, int, float]]:
    """(doc index, item id, words that agree, part held) of a shard."""
    ids = Vocabulary() if vocabulary is None else vocabulary
    number = ids.__getitem__
    parts = [list(map(number, written_words(t))) if t else [] for _, t in docs]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    doc_of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    flat: list[int] = []
    for k, p in enumerate(parts):
        flat += p
        flat.append(-2 - k)
    tokens = np.array(flat, dtype=np.int64)
    order = suffix_array(tokens)
    out = []
    for block in blocks:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        need = np.ceil(block.sizes * part)
        named, words = -1, []
        for at, where, n in longest_matches(tokens, order, block.tokens(ids), block.ends, seed):
            if not len(at):
                continue
            doc, item = doc_of[at], block.item[where]
            p, d = block.at[where], at - starts[doc]
            for own in _chains(doc, item, p, d, n, need):
                k, i = int(doc[own[0]]), int(item[own[0]])
                if k != named:
                    named, words = k, [ids.names[x] for x in parts[k]]
                agree, held = _passage(np.stack([p[own], d[own], n[own]], axis=1), block.words[i], words)
                if held >= part * block.sizes[i] and (held, agree) > best.get((k, i), (0, 0)):
                    best[k, i] = (held, agree)
        out += [(k, block.ids[i], agree, held / float(block.sizes[i])) for (k, i), (held, agree) in best.items()]
    return out


_VOCABULARY: list[Vocabulary] = []


def _vocabulary() -> Vocabulary:
    """The worker's vocabulary, begun anew where it has grown beyond MEMORY words."""
    if not _VOCABULARY or len(_VOCABULARY[0]) > MEMORY:
        _VOCABULARY[:] = [Vocabulary()]
    return _VOCABULARY[0]


def _blocks(items: DataFrame, item_id: str, text: str) -> list:
    """The items as broadcasts of at most ``BLOCK_WORDS`` words; the driver holds one block at a time."""
    context = items.sparkSession.sparkContext
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    out, own, words = [], [], 0
    for r in rows.toLocalIterator():
        size = len(r.t) // 4 + 1
        if own and words + size > BLOCK_WORDS:
            out.append(context.broadcast(own))
            own, words = [], 0
        own.append((r.i, r.t))
        words += size
    return [*out, context.broadcast(own)] if own else out


def leaks(documents: DataFrame, items: DataFrame, part: float = PART, seed: int = SEED, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_words, part: each document that holds at least ``part`` of an item's words as one passage.

    n_words are the words of the passage that agree with the item's, spelling and
    single characters aside; part also counts single wrong words between words that
    agree. Null and empty texts leak nothing, items of fewer than ``seed`` words are
    not found. Repeated documents give a row each, repeated items too; other columns
    are left out.
    """
    shared = _blocks(items, item_id, text)
    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, n_words int, part double"
    narrow = spread(narrow.where("text is not null"), "doc_id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [Items(shared[0].value)] if len(shared) == 1 else []

        def blocks() -> Iterator[Items]:
            if kept:
                yield kept[0]
                return
            for b in shared:
                yield Items(b.value)
                vars(b).pop("_value", None)  # one block in memory at a time

        docs: list[tuple[int, str]] = []
        size = 0

        def done() -> pd.DataFrame:
            hits = leaks_of(docs, blocks(), part, seed, _vocabulary())
            columns = {"doc_id": [docs[k][0] for k, *_ in hits], "item_id": [h[1] for h in hits], "n_words": [h[2] for h in hits], "part": [h[3] for h in hits]}
            return pd.DataFrame(columns).astype({"doc_id": "int64", "item_id": "int64", "n_words": "int32", "part": "float64"})

        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                docs.append((i, t))
                size += len(t) // 5 + 1
                if size >= SHARD_WORDS:
                    yield done()
                    docs, size = [], 0
        if docs:
            yield done()

    return narrow.mapInPandas(search, schema)


def clean(documents: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents without those that leak an item; documents with a null id stay."""
    key = parameters.get("doc_id", "doc_id")
    hit = leaks(documents, items, **parameters).select(F.col("doc_id").alias("_vf_hit")).distinct()
    return documents.join(hit, F.col(key) == F.col("_vf_hit"), "left_anti")
