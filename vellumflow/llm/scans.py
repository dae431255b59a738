"""Repair of text recognised from scanned pages.

A line's tokens are tested one by one against a lexicon counted over all lines: a
token may stand as it is, be a confusion of a known word, or, at a line's end, be the
first part of a word that goes on in the next line of the running text. Words inside
a line are neither split nor merged. Running titles and page numbers
are told from the running text at the edges of the scans of a volume. Paragraph
boundaries are chosen by dynamic programming over the lines of a scan.

A page is the unit of work: it needs the lexicon (bounded, broadcast), the titles
of its volume and of the scans near it, and the first token of the next scan, which
come by joins on (volume) and (volume, scan number). No volume is ever collected, so one that holds
a third of all scans does no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.canonical import distance
from vellumflow.operators.nested import index_of
from vellumflow.session import cut

#: Entries of a lexicon that goes to every worker at most; of a longer one each page gets its part.
MAX_LEXICON = 100_000
#: A word is known from so many occurrences on.
KNOWN = 4
#: A token may be a misreading if it occurs at most this part as often as the word.
RARE = 0.03
#: Scan numbers on either side in which a title of few scans, a chapter's say, has to recur.
NEAR = 8
#: Lines at the top and at the bottom of a scan that may be a title or a page number.
EDGE = 2
#: Bits that a word costs besides its own: with a space lost inside, with one too many, broken at a line's end without a hyphen.
SPLIT, MERGE, BREAK = 10.0, 6.0, 2.0
#: A form at lines' ends before a conjunction is a first member if it stands there more often than this part of the word that both make.
AT_ENDS = 0.1
#: Bits of a hyphen at a line's end that breaks no word; of one that stands apart.
ALONE, DASH = 60.0, 16.0

# Characters that end a line inside a word.
HYPHENS = "-¬=⸗­‐‑"
# Words that stand between an abbreviated first member and a second.
CONJUNCTIONS = frozenset("en of und oder et ou and or vel ac noch".split())
# Groups of letters that recognition takes for each other.
CONFUSED_GROUPS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("in", "m"), ("li", "h"), ("ni", "m"), ("ri", "n"))
# Letters that recognition takes for each other.
CONFUSED = frozenset(
    frozenset(x)
    for x in "ec nu hb tr vr gq ao il lt fs ſf ft ij ce kh uv iu yv yg oe oc ea bl dcl mn nr ns xz pq dl EF NM OQ CG BR IL lI Il hk zx rv"
    .split()
)
# Digits that stand for a letter.
DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "4": "a", "8": "b", "6": "b", "9": "g", "3": "e", "2": "z", "7": "t"})

_NOT_BLANK = r"[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EDGES = ".,;:!?()[]{}«»„“”‘\"…—–<>*"
_NUMBER = re.compile(r"^\d+(?:[½¼¾]|[.,:/-]\d+)*(?:den|sten|ten|sche|ste|de|te|th|st|nd|rd|er|re|e|me|ème|o)?[½¼¾]?$|^[½¼¾]$", re.I)
_ELISION = re.compile(r"^(?:[ldjmnstc]|qu|jusqu|lorsqu|puisqu|quoiqu|presqu|quelqu|aujourd)['’]", re.I)
_PAGE_WORD = re.compile(r"^(?:pag|pagina|page|blz|bladz|bl|fol|p|s|seite|nr|no)\b[.:]?", re.I)
_ROMAN = re.compile(r"^[ivxlc]{1,7}$|^[IVXLC]{1,7}$")
_CHAPTER = re.compile(r"HOOFD[S5]TUK|KAPITEL|CHAPIT|CHAPTER|CAPUT|AFDEELING|VOORREDE", re.I)
_PAGE_NUMBER = re.compile(r"^[\dlIiOoSB|]{1,5}[½¼¾]?$")


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return token.strip(_EDGES)


def title_form(line: str) -> str:
    """Letters of a line, lower-case, without page numbers, digits taken for letters read back."""
    words = [w for w in line.split() if not _PAGE_NUMBER.match(core(w))]
    return re.sub(r"[^a-zà-ÿœ ]+", "", " ".join(words).lower().translate(DIGITS)).strip()


def is_page_number(line: str) -> bool:
    """Whether a line is nothing but a page number, in whatever brackets and dashes."""
    bare = re.sub(r"[\s()\[\]{}—–\-·.,:*~=]+", " ", line).strip()
    bare = _PAGE_WORD.sub("", bare).strip()
    return bool(_ROMAN.match(bare)) or bool(_PAGE_NUMBER.match(bare)) and (any(c.isdigit() for c in bare) or len(bare) <= 3)


def page_value(line: str) -> int | None:
    """The number that a page-number line gives, letters taken for digits read back; null for roman and broken ones."""
    digits = re.sub(r"[^0-9lIiOoSB|½¼¾]", "", _PAGE_WORD.sub("", re.sub(r"^\W+", "", line)))
    digits = digits.translate(str.maketrans("lIi|OoSB", "11110058"))
    return int(digits) if digits.isdecimal() else None


def _in_capitals(line: str) -> bool:
    if sum(map(str.isupper, line)) < 7:
        return False
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 8 and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and len(line.split()) >= 2


def _looks_like_title(line: str) -> bool:
    return _in_capitals(line) and not _CHAPTER.search(line)


def interrupts(line: str) -> bool:
    """Whether a line stands between the lines of the running text: a heading in capitals, or bare numbers."""
    return _in_capitals(line) or not any(c.isalpha() for c in line)


def edge_titles(lines: list[str]) -> list[tuple[str, bool]]:
    """(title form, certain) of the lines of a scan that may be a running title."""
    places = sorted({*range(min(EDGE, len(lines))), *range(max(0, len(lines) - EDGE), len(lines))})
    return [(title_form(lines[k]), _looks_like_title(lines[k])) for k in places if len(title_form(lines[k])) >= 8]


def edge_forms(lines: list[str]) -> list[tuple[str, bool, str, bool]]:
    """(title form, at the top, line if it names a chapter, begins with a capital) of the lines of a scan that may be a title of few scans.

    Headings of chapters differ by their number only, so they are compared as they stand.
    """
    out = []
    for k in sorted({*range(min(EDGE, len(lines))), *range(max(0, len(lines) - EDGE), len(lines))}):
        form = title_form(lines[k])
        if len(form) >= 8:
            out.append((form, k < EDGE, "".join(c for c in lines[k].lower() if c.isalpha()) if _CHAPTER.search(lines[k]) else "", next((c for c in lines[k] if c.isalpha()), "").isupper()))
    return out


def _alike(a: str, grams: set[str], b: str, others: set[str]) -> bool:
    """Whether two title forms are one, misreadings allowed; an edit takes four three-letter grams at most, so most pairs need no distance."""
    most = max(1, max(len(a), len(b)) // 6)
    return a == b or abs(len(a) - len(b)) <= most and len(grams & others) >= len(grams) - 4 * most and distance(a, b, most) <= most


@lru_cache(20_000)
def _grams(form: str) -> frozenset[str]:
    return frozenset(form[i : i + 3] for i in range(len(form) - 2))


def _is_title(form: str, title: str) -> bool:
    """Whether a title form is a title, an edit in six letters allowed; few pairs need the distance, as an edit takes four three-letter grams at most."""
    most = max(1, len(title) // 6)
    if form == title or abs(len(form) - len(title)) > most or len(_grams(form) & _grams(title)) < len(_grams(title)) - 4 * most:
        return form == title
    return distance(form, title, most) <= most


def near_titles(scans: list[tuple[int, list[tuple[str, bool, str, bool]]]]) -> dict[int, list[str]]:
    """Of each scan the forms that recur, misreadings allowed, on the same edge of another scan at most ``NEAR`` numbers away.

    One of both has to begin with a capital, as lines inside a sentence do not.
    """
    places: dict[int, list] = defaultdict(list)
    for number, forms in scans:
        places[number] += [(form, top, chapter, capital, {form[i : i + 3] for i in range(len(form) - 2)}) for form, top, chapter, capital in forms]
    out: dict[int, list[str]] = {}
    for number, own in places.items():
        others = [x for m in range(number - NEAR, number + NEAR + 1) if m != number for x in places.get(m, ())]
        kept = {
            form
            for form, top, chapter, capital, grams in own
            if any(top == t and chapter == c and (capital or u) and (form == f or not chapter and _alike(form, grams, f, g)) for f, t, c, u, g in others)
        }
        if kept:
            out[number] = sorted(kept)
    return out


def noise_lines(lines: list[str], titles: list[str], expected: int | None = None) -> list[str]:
    """Of each line ``header``, ``page_no`` or '' (running text); only lines at the edges can be noise.

    expected: the page number that the volume's other scans lead to; a bare number
    that is another one belongs to the text.
    """
    out = [""] * len(lines)
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        for n, k in enumerate(order):
            if n >= EDGE or out[k]:
                if n >= EDGE:
                    break
                continue
            form = title_form(lines[k])
            bare = re.fullmatch(r"[\d½¼¾., ]+", lines[k].strip())
            if is_page_number(lines[k]) and not (bare and expected is not None and page_value(lines[k]) != expected):
                out[k] = "page_no"
            elif len(form) >= 6 and (_looks_like_title(lines[k]) or any(_is_title(form, t) for t in titles)):
                out[k] = "header"
            else:
                break
    return out


class Lexicon:
    """Counts of words, of neighbouring words whose letters joined are a word, and of abbreviated first members, inside lines and at their ends."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], suspended: dict[str, int], total: int, at_ends: dict[str, int] | None = None):
        self.words, self.pairs, self.suspended, self.at_ends = words, pairs, suspended, at_ends or {}
        self.total = max(total, 1)
        self.deleted: dict[str, list[str]] = defaultdict(list)
        for w, n in words.items():
            if n >= KNOWN and len(w) > 1:
                for v in {w[:i] + w[i + 1 :] for i in range(len(w))}:
                    self.deleted[v].append(w)
        self.memory: dict[tuple, bool] = {}
        self.edges: dict[str, float] = {}
        self.divisions: dict[str, tuple[float, int]] = {}

    @classmethod
    def of(cls, entries: Iterable[tuple[str, str, str, int]], total: int) -> Lexicon:
        """From (kind, a, b, n): ``word``, ``pair``, ``member``, ``end``; b is the second word of a pair."""
        kinds: dict[str, dict] = {"word": {}, "pair": {}, "member": {}, "end": {}}
        for kind, a, b, n in entries:
            kinds[kind][(a, b) if kind == "pair" else a] = n
        return cls(kinds["word"], kinds["pair"], kinds["member"], total, kinds["end"])

    def count(self, word: str) -> int:
        return self.words.get(word, 0)

    def near(self, word: str) -> list[tuple[str, bool]]:
        """(known word, whether by a usual confusion) in reach of one misread, missing or extra character."""
        found: dict[str, bool] = {}
        for w in self.deleted.get(word, ()):
            found[w] = False  # a character is missing
        for i in range(len(word)):
            short = word[:i] + word[i + 1 :]
            if self.words.get(short, 0) >= KNOWN:
                found.setdefault(short, False)  # one too many
            for w in self.deleted.get(short, ()):
                if len(w) == len(word) and w != word and w[:i] == word[:i] and w[i + 1 :] == word[i + 1 :]:
                    found[w] = found.get(w, False) or frozenset((word[i], w[i])) in CONFUSED
        for a, b in CONFUSED_GROUPS:
            for x, y in ((a, b), (b, a)):
                at = word.find(x)
                while at >= 0:
                    w = word[:at] + y + word[at + len(x) :]
                    if self.words.get(w, 0) >= KNOWN:
                        found[w] = True
                    at = word.find(x, at + 1)
        return list(found.items())

    def misread(self, token: str) -> bool:
        """Whether a whole token has a wrong, missing or extra character."""
        word = core(token)
        if not word:
            return False
        key = (word, token[-1:] in "'’")
        known = self.memory.get(key)
        if known is None:
            if len(self.memory) > 300_000:
                self.memory.clear()
            known = self.memory[key] = self._misread(word)
        return known

    def _misread(self, word: str) -> bool:
        if _NUMBER.match(word):
            return False
        if not any(c.isalpha() for c in word):
            return False
        low = word.lower()
        plain = _ELISION.sub("", low)
        if plain != low and self.count(low) < KNOWN and self.count(plain) < max((self.count(w) for w, _ in self.near(low)), default=0):
            plain = low  # a mark in place of a letter
        plain = re.sub(r"['’]s$|['’]$", "", plain)
        if any(not c.isalpha() and c not in "-‐" for c in plain):
            # A digit or a mark inside the word; an abbreviation's stop or a known form is none.
            return not (self._own_form(low, plain) or re.fullmatch(r"(?:\w\.)+\w?", low) and not any(c.isdigit() for c in low))
        if any(c.islower() and d.isupper() for c, d in zip(word, word[1:])):
            return True
        parts = [plain] if "-" not in plain or self.count(plain) >= KNOWN else plain.split("-")
        if word[-1] in HYPHENS and len(parts) > 1 and self.is_member(parts[-2]):
            parts = parts[:-2]  # the first member of compounds, abbreviated
        return any(self._unlikely(p, word[:1].isupper()) for p in parts if p)

    def is_member(self, head: str) -> bool:
        """Whether a form is known as an abbreviated first member of compounds."""
        return self.suspended.get(head, 0) >= KNOWN or self.at_ends.get(head, 0) >= KNOWN

    def _own_form(self, low: str, plain: str) -> bool:
        """Whether a form with a digit or mark inside is known as such: it occurs more often than every word it may be read as."""
        own = self.count(low)
        if own < KNOWN or _PAGE_NUMBER.match(low):
            return False
        read: set[str] = set()
        for x in {low, plain}:
            for y in {x, x.translate(DIGITS)}:
                read |= {y, re.sub(r"[^\w'’-]", "", y), re.sub(r"[\W\d_]", "", y)}
        near = {w for x in read for w, _ in self.near(x)}
        # Readings that hold a digit or mark themselves say nothing.
        return own > max((self.count(w) for w in read | near if w and w.replace("-", "").isalpha()), default=0)

    def _unlikely(self, low: str, capital: bool) -> bool:
        own = self.count(low)
        for w, usual in self.near(low):
            n = self.count(w)
            least = 3 if usual else 8
            rare = RARE if usual else RARE / 4
            if capital:
                least, rare = 2 * least, rare / 2
            if min(len(low), len(w)) < 4:
                rare = rare / 2 if usual else rare / 2.5
                least *= 10
                if not usual and len(w) < 3:
                    continue
            if n >= max(least, KNOWN) and own <= rare * n + (2 if n >= 6 * least else 1 if n >= 3 * least else 0):
                return True
        return False

    def cost(self, word: str) -> float:
        """Bits of a word: by its frequency if known, as a misreading of a near word, else by its length."""
        low = core(word).lower()
        n = self.count(low)
        if n >= 2:
            return -math.log2(n / self.total)
        best = 9.0 + 3.2 * len(low) + (4.0 if n == 0 else 0.0)
        for w, _ in self.near(low):
            best = min(best, 9.0 - math.log2(self.count(w) / self.total))
        return best

    def whole(self, token: str) -> float:
        """Bits of a token that is one word as it stands, known or misread."""
        known = self.edges.get(token)
        if known is None:
            if len(self.edges) > 300_000:
                self.edges.clear()
            known = self.edges[token] = self.cost(token)
        return known

    def divided(self, token: str) -> tuple[float, int]:
        """(bits, place) of the best division of a token into two known words; infinite bits if there is none."""
        known = self.divisions.get(token)
        if known is None:
            if len(self.divisions) > 300_000:
                self.divisions.clear()
            best = (math.inf, 0)
            word = core(token)
            if len(word) > 4 and word.isalpha() and self.count(word.lower()) < 2:
                low, at = word.lower(), token.find(word)
                for i in range(2, len(low) - 1):
                    if self.count(low[:i]) >= KNOWN and self.count(low[i:]) >= KNOWN and not word[i].isupper():
                        best = min(best, (SPLIT + self.cost(low[:i]) + self.cost(low[i:]), at + i))
            known = self.divisions[token] = best
        return known

    def within(self, a: str, b: str) -> tuple[float, float]:
        """(bits of two neighbouring tokens of a line as one word, bits that their standing apart costs besides their own)."""
        if not (a[-1:].isalpha() and b[:1].islower()):
            return math.inf, 0.0
        low = (core(a).lower(), core(b).lower())
        joined = low[0] + low[1]
        if self.count(joined) < KNOWN or self.count(low[0]) >= 2 and self.count(low[1]) >= 2:
            return math.inf, 0.0
        return MERGE + self.cost(joined), 0.0

    def across(self, last: str, following: str, set_off: bool = False) -> tuple[float, float]:
        """(bits of a line's last token and the first of the next as one word, bits that their standing apart costs besides their own).

        set_off: the hyphen stood apart, so it may as well be a dash.
        """
        bare = last.rstrip(_EDGES) if last[-1:] not in HYPHENS else last
        hyphen = bare[-1:] in HYPHENS and len(bare) > 1
        first = bare.rstrip(HYPHENS)
        if not first or not first[-1:].isalpha():
            return math.inf, 0.0
        head, nxt = core(first), core(following)
        joined = (head + re.match(r"[^\W\d_]*", nxt)[0]).lower()
        if hyphen:
            if nxt.lower() in CONJUNCTIONS:
                # An abbreviated first member, unless the two parts make a known word and the first is no known member.
                n = self.count((head + nxt).lower())
                member = self.suspended.get(head.lower(), 0) >= KNOWN or self.at_ends.get(head.lower(), 0) >= max(KNOWN, AT_ENDS * n)
                return (self.cost(head + nxt) + self.cost(nxt) if n >= KNOWN else math.inf), (-ALONE if member else 0.0)
            if set_off and nxt:
                apart = nxt[0].isupper() and not head[0].isupper() or not any(c.isalpha() for c in nxt)
                apart = apart or self.count(joined) < 2 and self.count(head.lower()) >= KNOWN and self.count(nxt.lower()) >= KNOWN
                return (math.inf if apart else self.cost(joined)), DASH
            return self.cost(joined), ALONE
        if last != last.rstrip(_EDGES) or not nxt or not nxt[0].islower():
            return math.inf, 0.0
        if self.count(joined) < 2 and not (len(joined) > 5 and self.near(joined)):
            # Both parts unknown (a name, say): one word if neither could stand alone.
            if self.count(head.lower()) >= 2 or self.count(nxt.lower()) >= 2 or len(head) < 2 or len(nxt) < 2 or not self._part(head, nxt):
                return math.inf, 0.0
        seen = self.pairs.get((head.lower(), nxt.lower()), 0)
        apart = self.cost(head) + self.cost(nxt)
        return BREAK + self.cost(joined), (min(apart, -math.log2(seen / self.total)) - apart if seen else 0.0)

    def _part(self, head: str, nxt: str) -> bool:
        near = lambda x: any(self.count(w) >= 10 for w, _ in self.near(x.lower()))
        return not near(head) and not near(nxt)


# Spark side


def pages(scans: DataFrame) -> DataFrame:
    """rec_id, volume, scan_number, lines: the running text's lines of each record in reading order.

    lines is an array of (region_id, line_id, text); notes in the margin
    (sub-regions), null lines and lines without text are left out. Order is the
    region's index (custom, else reading_order, else place), then the line's. All
    inside the record: no shuffle.
    """
    ordered = F.filter(F.coalesce(F.col("reading_order"), F.array()), lambda r: r.isNotNull())
    late = F.lit(1_000_000)

    def region(g: Column, i: Column) -> Column:
        listed = F.get(F.filter(ordered, lambda o: o["region_ref"] == g["region_id"]), F.lit(0))["idx"]
        place = F.coalesce(index_of(g["custom"]), listed, i + late)

        def line(x: Column, j: Column) -> Column:
            texts = F.filter(F.coalesce(x["text_equiv"], F.array()), lambda t: F.coalesce(t["unicode_text"], t["plain_text"]).isNotNull())
            first = F.get(texts, F.lit(0))
            return F.struct(
                place.alias("r"),
                i.alias("i"),
                F.coalesce(index_of(x["custom"]), j + late).alias("l"),
                j.alias("j"),
                F.coalesce(g["region_id"], F.lit("")).alias("region_id"),
                F.coalesce(x["line_id"], F.lit("")).alias("line_id"),
                F.coalesce(first["unicode_text"], first["plain_text"]).alias("text"),
            )

        held = F.filter(F.coalesce(g["text_lines"], F.array()), lambda x: x.isNotNull())
        return F.filter(F.transform(held, line), lambda x: F.coalesce(x["text"], F.lit("")).rlike(_NOT_BLANK))

    regions = F.filter(F.coalesce(F.col("regions"), F.array()), lambda g: g.isNotNull())
    lines = F.array_sort(F.flatten(F.transform(regions, region)))
    kept = F.transform(lines, lambda x: F.struct(x["region_id"].alias("region_id"), x["line_id"].alias("line_id"), x["text"].alias("text")))
    return scans.select("rec_id", "volume", "scan_number", kept.alias("lines"))


_EDGE = "struct<form:string,sure:boolean,top:boolean,chapter:string,capital:boolean>"


def edges_of(paged: DataFrame) -> DataFrame:
    """rec_id, volume, scan_number, edges, numbers: what the lines at the edges of each record may be, titles and page numbers."""

    @F.pandas_udf(f"edges array<{_EDGE}>, numbers array<int>")
    def edges(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            lines = list(t)
            sure: dict[str, bool] = {}
            for f, c in edge_titles(lines):
                sure[f] = sure.get(f, False) or c
            forms = [{"form": f, "sure": sure[f], "top": top, "chapter": c, "capital": u} for f, top, c, u in edge_forms(lines)]
            at = {*range(min(EDGE, len(lines))), *range(max(0, len(lines) - EDGE), len(lines))}
            found = {page_value(lines[k]) for k in at if is_page_number(lines[k])}
            out.append((forms, sorted(n for n in found if n is not None and n < 100_000)))
        return pd.DataFrame(out, columns=["edges", "numbers"])

    return paged.select("rec_id", "volume", "scan_number", edges(F.transform("lines", lambda x: x["text"])).alias("e")).select("rec_id", "volume", "scan_number", "e.*")


def titles_of(edges: DataFrame) -> DataFrame:
    """volume, titles: the running titles of each volume, most frequent first.

    A title is a line at a scan's edge whose letters recur at the edge of every
    eighth scan of the volume, three at least; if it is all in capitals, of every
    fiftieth. A scan has few edge lines, so a volume has few such titles, however
    many scans it has. Titles of fewer scans come from ``near_titles_of``.
    """
    scans = edges.select("volume", "scan_number").distinct().groupBy("volume").agg(F.count("scan_number").alias("n"))
    forms = edges.select("volume", "scan_number", F.inline("edges")).groupBy("volume", "form", "scan_number").agg(F.max("sure").alias("sure"))
    forms = forms.groupBy("volume", "form").agg(F.count("scan_number").alias("k"), F.max("sure").alias("sure"))
    frequent = forms.join(scans.withColumnRenamed("volume", "_vf_v"), F.col("volume").eqNullSafe(F.col("_vf_v"))).where(
        (F.col("k") >= F.greatest(F.lit(3), F.col("n") / 8)) | (F.col("sure") & (F.col("k") >= F.greatest(F.lit(1), F.col("n") / 50)))
    )
    return frequent.groupBy("volume").agg(F.sort_array(F.collect_list(F.struct("k", "form")), asc=False).alias("t")).select(
        "volume", F.transform("t", lambda x: x["form"]).alias("titles")
    )


def near_titles_of(edges: DataFrame) -> DataFrame:
    """volume, scan_number, titles: the forms at a scan's edges that recur on scans near it.

    Scans are grouped by (volume, block of 4 * ``NEAR`` numbers) with the scans near
    the block, so no group grows with its volume. A null scan number has none near it.
    """

    @F.pandas_udf("array<struct<scan_number:int,titles:array<string>>>")
    def recurring(blocks: pd.Series, scans: pd.Series) -> pd.Series:
        out = []
        for block, rows in zip(blocks, scans):
            found = near_titles([(int(r["scan_number"]), [(f["form"], bool(f["top"]), f["chapter"], bool(f["capital"])) for f in r["edges"]]) for r in rows])
            out.append([{"scan_number": n, "titles": t} for n, t in found.items() if n // size == block])
        return pd.Series(out)

    size = 4 * NEAR
    block = lambda shift: F.floor((F.col("scan_number") + shift) / size)
    rows = edges.where(F.col("scan_number").isNotNull() & (F.size("edges") > 0)).select("volume", "scan_number", "edges")
    # A scan near the border of its block also goes to the block beyond it.
    rows = rows.select("*", F.explode(F.array_distinct(F.array(block(-NEAR), block(0), block(NEAR)))).alias("block"))
    groups = rows.groupBy("volume", "block").agg(F.collect_list(F.struct("scan_number", "edges")).alias("scans"))
    return groups.select("volume", F.inline(recurring("block", "scans")))


def lexicon_of(paged: DataFrame) -> tuple[DataFrame, int]:
    """(kind, a, b, n) of all that the decisions count over all lines, and the number of words.

    ``word``: inner tokens of lines, which are whole, and their parts between
    hyphens; ``pair``: neighbouring tokens whose letters joined are a word;
    ``member``: an abbreviated first member before a conjunction inside a line,
    ``end``: one at a line's end. Forms seen once are left out.
    """
    bare = rf"^[{re.escape(_EDGES)}]+|[{re.escape(_EDGES)}]+$"
    texts = F.transform("lines", lambda x: x["text"])
    lines = paged.select(F.inline(F.transform(texts, lambda x, i: F.struct(x.alias("text"), F.get(texts, i + 1).alias("following")))))
    tokens = lines.select(F.split(F.trim("text"), r"\s+").alias("t"))
    inner = tokens.select(F.when(F.size("t") > 2, F.slice("t", F.lit(2), F.size("t") - 2)).otherwise(F.array()).alias("t"))
    whole = F.transform("t", lambda x: F.lower(F.regexp_replace(x, bare, "")))
    inner = inner.select(whole.alias("t"))
    parts = F.flatten(F.transform(F.filter("t", lambda x: F.instr(x, "-") > 1), lambda x: F.split(x, "-")))
    counted = cut(inner.select(F.explode(F.concat("t", parts)).alias("a")).where("a <> ''").groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 1
    words = counted.where("n >= 2")
    # Pairs are counted only where their letters joined are a word: in the worker if it can hold all words, else by a join.
    held = [r.a for r in words.select("a").limit(MAX_LEXICON + 1).collect()]
    known = paged.sparkSession.sparkContext.broadcast(frozenset(held) if len(held) <= MAX_LEXICON else None)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "a", "b", "joined", "n"]
        seen: Counter = Counter()
        rows = lambda: pd.DataFrame([(*k, n) for k, n in seen.items()], columns=columns)
        words = known.value
        for batch in batches:
            for text, following in zip(batch["text"], batch["following"]):
                ts = text.split()
                for a, b in zip(ts, ts[1:]):
                    if a[-1] in HYPHENS:
                        if core(b).lower() in CONJUNCTIONS:
                            seen["member", core(a).rstrip(HYPHENS).lower(), "", ""] += 1
                    elif a[-1].isalpha() and core(a) == a:
                        low = (a.lower(), core(b).lower())
                        joined = low[0] + low[1]
                        if low[1] and (words is None or joined in words):
                            seen["pair", *low, joined] += 1
                if ts and following and ts[-1][-1] in HYPHENS and core(following.split()[0]).lower() in CONJUNCTIONS:
                    seen["end", core(ts[-1]).rstrip(HYPHENS).lower(), "", ""] += 1
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
        yield rows()

    rest = lines.mapInPandas(others, "kind string, a string, b string, joined string, n long").groupBy("kind", "a", "b", "joined").agg(F.sum("n").alias("n"))
    if known.value is None:
        rest = rest.join(words.select(F.col("a").alias("w")), F.col("joined") == F.col("w"), "left").where("kind <> 'pair' or w is not null")
    return cut(words.select(F.lit("word").alias("kind"), "a", F.lit("").alias("b"), "n").unionByName(rest.select("kind", "a", "b", "n"))), total


def forms_asked(lines: list[str]) -> tuple[dict[str, bool], set[tuple[str, str]]]:
    """What decoding consecutive lines may ask a lexicon: forms (and whether words near them), pairs of words."""
    forms: dict[str, bool] = {"": False}
    pairs: set[tuple[str, str]] = set()

    def near(word: str) -> None:
        low = word.lower()
        plain = _ELISION.sub("", low)
        for x in {low, plain, re.sub(r"['’]s$|['’]$", "", plain), re.sub(r"['’]s$|['’]$", "", low)}:
            for part in {x, *x.split("-")}:
                for y in {part, part.translate(DIGITS)}:
                    for z in (y, re.sub(r"[^\w'’-]", "", y), re.sub(r"[\W\d_]", "", y), re.sub(r"(?<=[^\W\d_])['’](?=[^\W\d_]{3})", "", y), re.sub(r"[^\w'’-]|(?<=[^\W\d_])['’](?=[^\W\d_]{3})", "", y)):
                        forms[z] = True

    rows = [line.split() for line in lines]
    for row in rows:
        for t in row:
            word = core(t)
            for x in (word, word.rstrip(HYPHENS), core(t.rstrip(HYPHENS)), core(word.rstrip(HYPHENS))):
                near(x)
            low = word.lower()
            if word.isalpha():
                for i in range(2, len(low) - 1):
                    forms.setdefault(low[:i], False)
                    forms.setdefault(low[i:], False)
        for a, b in zip(row, row[1:]):
            low = core(a).lower(), core(b).lower()
            forms.setdefault("".join(low), False)
            pairs.add(low)
    # Lines that stand next to each other in the running text may have headings between them.
    for n, row in enumerate(rows):
        heads = [row[-1]] if len(row) < 2 else [row[-1], row[-2] + row[-1]]
        for m in range(n + 1, len(rows)):
            nxt = core(rows[m][0])
            for head in heads if row else ():
                h = core(head.rstrip(_EDGES).rstrip(HYPHENS))
                letters = re.match(r"[^\W\d_]*", nxt)[0]
                for x in (h + nxt, h + letters, f"{h}-{nxt}", core(head.rstrip(HYPHENS)) + nxt):
                    near(x)
                pairs.add((h.lower(), nxt.lower()))
                if len(rows[m]) == 1 and m + 1 < len(rows):
                    for far in range(m + 1, min(len(rows), m + 6)):
                        beyond = core(rows[far][0])
                        middle = core(rows[m][0].rstrip(HYPHENS))
                        for x in (h + middle + beyond, h + middle + re.match(r"[^\W\d_]*", beyond)[0]):
                            near(x)
            if not interrupts(" ".join(rows[m])) and m > n + EDGE:
                break
    return forms, pairs


def _variants(word: str) -> set[str]:
    """A form and what it is with one character less or with one confused group, by which near words meet."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    for a, b in CONFUSED_GROUPS:
        for x, y in ((a, b), (b, a)):
            at = word.find(x)
            while at >= 0:
                out.add(word[:at] + y + word[at + len(x) :])
                at = word.find(x, at + 1)
    return out


def _parts_of_lexicon(known: DataFrame, entries: DataFrame) -> DataFrame:
    """rec_id, lexicon: for each page the entries that its decoding may ask for, found by joins.

    Each different form is looked up once, by itself and by its variants; the pages
    get the answers by form.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, ls, b, f in zip(batch["rec_id"], batch["texts"], batch["before"], batch["following"]):
                forms, pairs = forms_asked([x for x in (b, *ls, f) if x])
                rows += [(i, "near" if n else "word", x, "") for x, n in forms.items()]
                rows += [(i, "pair", x, y) for x, y in pairs]
            yield pd.DataFrame(rows, columns=["rec_id", "kind", "a", "b"])

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, a, v) for k, a in zip(batch["kind"], batch["a"]) for v in (_variants(a) if k == "near" else (a,))]
            yield pd.DataFrame(rows, columns=["kind", "a", "v"])

    texts = F.transform("lines", lambda x: x["text"])
    wanted = cut(known.select("rec_id", texts.alias("texts"), "before", "following").mapInPandas(asked, "rec_id long, kind string, a string, b string"))
    forms = wanted.where("kind <> 'pair'").select("kind", "a").distinct()
    by_variant = forms.mapInPandas(variants, "kind string, a string, v string")
    words = entries.where("kind = 'word'").select(F.lit("near").alias("k"), F.col("a").alias("w"), "n").mapInPandas(
        lambda batches: (pd.DataFrame([(w, n, v) for w, n in zip(x["w"], x["n"]) for v in _variants(w)], columns=["w", "n", "v"]) for x in batches), "w string, n long, v string"
    )
    found = by_variant.join(words, "v").where("kind = 'near' or a = w").select("kind", "a", F.lit("word").alias("is"), "w", F.lit("").alias("b"), "n").distinct()
    # First members are few words, and each word may be one.
    members = entries.where("kind in ('member', 'end')").select(F.col("kind").alias("is"), F.col("a").alias("w"), "n")
    found = found.unionByName(forms.join(members, forms.a == members.w).select("kind", "a", "is", "w", F.lit("").alias("b"), "n"))
    found = found.groupBy("kind", "a").agg(F.collect_set(F.struct(F.col("is").alias("kind"), F.col("w").alias("a"), "b", "n")).alias("e"))
    pairs = entries.where("kind = 'pair'").select("kind", "a", "b", F.array(F.struct("kind", "a", "b", "n")).alias("e"))
    held = wanted.where("kind <> 'pair'").join(found, ["kind", "a"]).select("rec_id", "e").unionByName(wanted.join(pairs, ["kind", "a", "b"]).select("rec_id", "e"))
    return held.groupBy("rec_id").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("lexicon"))


def _tail(text: str) -> tuple[list[str], bool]:
    """Tokens of a line and whether its closing hyphen stood apart; such a hyphen is put to the word before it."""
    tokens = text.split()
    if len(tokens) > 1 and tokens[-1] in HYPHENS:
        return [*tokens[:-2], tokens[-2] + tokens[-1]], True
    return tokens, False


def _first_and_last(lines: list[str], titles: list[str], expected: int | None) -> tuple[str | None, str | None]:
    """First and last line of the running text of a page."""
    kept = [t for t, k in zip(lines, noise_lines(lines, titles, expected)) if not k and not interrupts(t)]
    return (kept[0], kept[-1]) if kept else (None, None)


class Word(NamedTuple):
    """A word of the decoded stream: tokens from ``start`` to before ``end``, ``at`` > 0 if it is divided there."""

    start: int
    end: int
    at: int = 0


def words_of_stream(lines: list[list[str]], set_off: list[bool], lexicon: Lexicon) -> list[Word]:
    """The cheapest reading of lines of tokens as one stream of words, by Viterbi over all places where a word may end.

    A word is a token as it stands (known, unknown, or a confusion of a known word),
    a token divided in two, two tokens of a line in one, or the end of a line with
    the beginning of the next (through a line of one token, also with the one after).
    set_off says of each line whether its closing hyphen stood apart.
    """
    tokens = [t for line in lines for t in line]
    breaks: dict[int, bool] = {}
    k = 0
    for line, apart in zip(lines, set_off):
        k += len(line)
        breaks[k] = apart
    n = len(tokens)
    best, back = [0.0] + [math.inf] * n, [Word(0, 0)] * (n + 1)
    # What it costs that a word ends at a place.
    ends = [0.0] * (n + 1)
    one_word: list[float] = [math.inf] * (n + 1)
    for k in range(1, n):
        a, b = tokens[k - 1], tokens[k]
        one_word[k], ends[k] = lexicon.across(a, b, breaks[k]) if k in breaks else lexicon.within(a, b)
    for k in range(n):
        here, token = best[k] + ends[k], tokens[k]
        at_break = k + 1 in breaks
        own = here + lexicon.whole(token.rstrip(HYPHENS) if at_break else token)
        if own < best[k + 1]:
            best[k + 1], back[k + 1] = own, Word(k, k + 1)
        if not at_break or token[-1:] not in HYPHENS:
            bits, at = lexicon.divided(token)
            if here + bits < best[k + 1]:
                best[k + 1], back[k + 1] = here + bits, Word(k, k + 1, at)
        if k + 1 < n and here + one_word[k + 1] < best[k + 2]:
            best[k + 2], back[k + 2] = here + one_word[k + 1], Word(k, k + 2)
        if k + 2 < n and at_break and k + 2 in breaks and one_word[k + 1] < math.inf and tokens[k + 1][-1:] in HYPHENS:
            bits = lexicon.across(token.rstrip(HYPHENS) + tokens[k + 1], tokens[k + 2], breaks[k + 2])[0]
            if here + bits < best[k + 3]:
                best[k + 3], back[k + 3] = here + bits, Word(k, k + 3)
    out, k = [], n
    while k:
        out.append(back[k])
        k = back[k].start
    return out[::-1]


def goes_on(before: str | None, following: str | None, lexicon: Lexicon) -> bool:
    """Whether the last word of a scan's last line goes on in the first line of the next scan; both scans decide alike."""
    if not before:
        return False
    tokens, apart = _tail(before)
    if not following:
        return not apart and len(tokens[-1]) > 1 and tokens[-1][-1] in HYPHENS and tokens[-1].rstrip(HYPHENS)[-1:].isalpha()
    words = words_of_stream([tokens, following.split()], [apart, False], lexicon)
    return any(w.start < len(tokens) < w.end for w in words)


class Line(NamedTuple):
    """A decoded line: kind of noise, tokens, whether it ends inside a word, of each token whether it is misread and its text in the repaired stream (empty if it belongs to the word before)."""

    kind: str
    tokens: list[str]
    broken: bool
    wrong: list[bool]
    texts: list[str]


def decode(lines: list[str], titles: list[str], expected: int | None, before: str | None, following: str | None, lexicon: Lexicon) -> list[Line]:
    """The lines of a page, decoded as one stream.

    before: the last line of the scan before; following: the first line of the next
    scan. kind is as in ``noise_lines``. A word over a line's end has its whole
    repaired text at its first token. Headings stand outside the stream, so a word
    may go on behind them.
    """
    kinds = noise_lines(lines, titles, expected)
    text = [k for k, kind in enumerate(kinds) if not kind and not interrupts(lines[k])]
    tails = [_tail(lines[k]) for k in text]
    into = bool(text) and goes_on(before, lines[text[0]], lexicon)
    onward = bool(text) and goes_on(lines[text[-1]], following, lexicon)
    # Words that are shared with a neighbouring scan are decided already.
    own = [t for t, _ in tails]
    if into:
        own = [own[0][1:], *own[1:]]
    if onward:
        own = [*own[:-1], own[-1][:-1]]
    words = words_of_stream(own, [apart for _, apart in tails], lexicon)
    stream = [(n, k) for n, line in enumerate(own) for k in range(len(line))]
    shift = lambda n: 1 if into and n == 0 else 0
    wrong = [[False] * len(t) for t, _ in tails]
    texts = [list(t) for t, _ in tails]
    broken = [False] * len(text)
    for w in words:
        n, k = stream[w.start]
        last = k == len(own[n]) - 1
        k += shift(n)
        token = tails[n][0][k]
        if w.end - w.start == 1:
            if w.at:
                texts[n][k] = f"{token[: w.at]} {token[w.at :]}"
            elif lexicon.misread(token.rstrip(HYPHENS) if last and tails[n][1] else token):
                wrong[n][k] = True
                texts[n][k] = corrected(token, lexicon)
            continue
        parts = [stream[x] for x in range(w.start, w.end)]
        for (m, _), (other, _) in zip(parts, parts[1:]):
            broken[m] = broken[m] or m != other
        pieces = [tails[m][0][j + shift(m)] for m, j in parts]
        texts[n][k] = repaired(pieces, lexicon)
        for m, j in parts[1:]:
            texts[m][j + shift(m)] = ""
    if into:
        texts[0][0] = ""
    if onward:
        pieces = [tails[-1][0][-1], following.split()[0]] if following else [tails[-1][0][-1]]
        texts[-1][-1] = repaired(pieces, lexicon)
        broken[-1] = True
    out, at = [], {k: n for n, k in enumerate(text)}
    for k, kind in enumerate(kinds):
        n = at.get(k)
        if n is None:
            tokens = lines[k].split()
            # Headings and numbers: known words in capitals are few, so only marks and digits inside a word tell.
            marks = [not kind and any(c.isalpha() for c in t) and not core(t).replace("-", "").isalpha() and lexicon.misread(t) for t in tokens]
            out.append(Line(kind, tokens, False, marks, [corrected(t, lexicon) if m else t for t, m in zip(tokens, marks)]))
            continue
        tokens, apart = tails[n]
        if apart and not broken[n]:
            # The hyphen that stood apart was a dash.
            plain = lines[k].split()
            out.append(Line(kind, plain, False, [*wrong[n], False], [*texts[n][:-1], texts[n][-1].rstrip(HYPHENS), plain[-1]]))
        else:
            out.append(Line(kind, tokens, broken[n], wrong[n], texts[n]))
    return out


def repaired(pieces: list[str], lexicon: Lexicon) -> str:
    """Tokens that are parts of one word as that word: hyphens go, but for those of a compound, and a misreading of a known word is set right."""
    text = pieces[0]
    for nxt in pieces[1:]:
        head = text.rstrip(HYPHENS) if text[-1:] in HYPHENS else text
        low = core(head).lower(), core(nxt).lower()
        hyphen = text != head and lexicon.count("-".join(low)) > lexicon.count("".join(low))
        text = head + "-" * hyphen + nxt
    word = core(text)
    return corrected(text, lexicon) if word.isalpha() and lexicon.count(word.lower()) < 2 else text


_LEXICONS: dict[tuple, Lexicon] = {}
_ENTRIES = "array<struct<kind:string,a:string,b:string,n:bigint>>"


def offsets_of(edges: DataFrame) -> DataFrame:
    """volume, shift: page number minus scan number, where at least three scans of the volume, and most of those with a number, agree."""
    shifts = edges.select("volume", "scan_number", F.explode("numbers").alias("n")).select("volume", "scan_number", (F.col("n") - F.col("scan_number")).alias("shift")).distinct()
    counts = shifts.groupBy("volume", "shift").agg(F.count("scan_number").alias("k"))
    return counts.groupBy("volume").agg(F.max_by("shift", F.struct("k", "shift")).alias("shift"), F.max("k").alias("k"), F.sum("k").alias("all")).where("k >= 3 and 2 * k >= all")


def _with_context(paged: DataFrame) -> DataFrame:
    """Pages with titles, expected page number, last line of the scan before and first line of the next scan."""
    edges = cut(edges_of(paged))
    titles = titles_of(edges).select(F.col("volume").alias("_vf_v"), "titles")
    shifts = offsets_of(edges).select(F.col("volume").alias("_vf_w"), "shift")
    near = near_titles_of(edges).select(F.col("volume").alias("_vf_x"), F.col("scan_number").alias("_vf_s"), F.col("titles").alias("near"))
    known = paged.join(titles, F.col("volume").eqNullSafe(F.col("_vf_v")), "left").join(shifts, F.col("volume").eqNullSafe(F.col("_vf_w")), "left")
    known = known.join(near, F.col("volume").eqNullSafe(F.col("_vf_x")) & (F.col("scan_number") == F.col("_vf_s")), "left")
    none = F.array().cast("array<string>")

    @F.pandas_udf("first string, last string")
    def ends(texts: pd.Series, titles: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = [_first_and_last(list(t), list(h), None if pd.isna(e) else int(e)) for t, h, e in zip(texts, titles, expected)]
        return pd.DataFrame(rows, columns=["first", "last"])

    known = known.select("rec_id", "volume", "scan_number", "lines", F.array_union(F.coalesce("titles", none), F.coalesce("near", none)).alias("titles"), (F.col("scan_number") + F.col("shift")).alias("expected"))
    known = cut(known.withColumn("ends", ends(F.transform("lines", lambda x: x["text"]), F.col("titles"), F.col("expected"))))
    # Deliveries of a scan hold the same text; the first one stands for the scan.
    edge = known.where("scan_number is not null").groupBy("volume", "scan_number").agg(F.min_by("ends", "rec_id").alias("e"))
    to_next = F.struct((F.col("scan_number") + 1).alias("_vf_ns"), F.col("e.last").alias("before"), F.lit(None).cast("string").alias("following"))
    to_last = F.struct((F.col("scan_number") - 1).alias("_vf_ns"), F.lit(None).cast("string").alias("before"), F.col("e.first").alias("following"))
    around = edge.select(F.col("volume").alias("_vf_nv"), F.inline(F.array(to_next, to_last))).groupBy("_vf_nv", "_vf_ns").agg(F.max("before").alias("before"), F.max("following").alias("following"))
    both = known.join(around, F.col("volume").eqNullSafe(F.col("_vf_nv")) & (F.col("scan_number") == F.col("_vf_ns")), "left")
    return both.select("rec_id", "volume", "scan_number", "lines", "titles", "expected", "before", "following")


def _with_lexicon(paged: DataFrame, context: DataFrame):
    """(pages with context and, in ``lexicon``, their part of the lexicon; a function that gives a page's lexicon inside a worker).

    A lexicon of up to ``MAX_LEXICON`` entries goes to every worker, which builds it
    once, and ``lexicon`` is null; of a longer one each page gets what it may ask for.
    """
    entries, total = lexicon_of(paged)
    small = entries.limit(MAX_LEXICON + 1).count() <= MAX_LEXICON
    spark = paged.sparkSession.sparkContext
    shared = spark.broadcast([tuple(r) for r in entries.select("kind", "a", "b", "n").collect()] if small else [])
    key = (spark.applicationId, shared._jbroadcast.id())

    def own(part) -> Lexicon:
        if not small:
            return Lexicon.of([(r["kind"], r["a"], r["b"], r["n"]) for r in part] if part is not None else [], total)
        if key not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[key] = Lexicon.of(shared.value, total)
        return _LEXICONS[key]

    if small:
        return context.withColumn("lexicon", F.lit(None).cast(_ENTRIES)), own
    return context.join(_parts_of_lexicon(context, entries), "rec_id", "left"), own


def noise(scans: DataFrame) -> DataFrame:
    """rec_id, region_id, line_id, noise: the kinds of noise of each line of every delivered record.

    noise is ``header``, ``page_no``, ``broken_word`` or ``misread``; the last two may
    both hold. Margin notes, null and empty lines have none; an empty table gives an
    empty table. Null volumes form a volume of their own; a null scan number has no
    neighbour.
    """
    paged = cut(pages(scans))
    context, lexicon = _with_lexicon(paged, _with_context(paged))

    @F.pandas_udf("array<struct<region_id:string,line_id:string,noise:string>>")
    def found(lines: pd.Series, titles: pd.Series, expected: pd.Series, before: pd.Series, following: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for ls, hs, e, b, f, p in zip(lines, titles, expected, before, following, part):
            rows = []
            for x, line in zip(ls, decode([x["text"] for x in ls], list(hs), None if pd.isna(e) else int(e), b or None, f or None, lexicon(p))):
                kinds = [line.kind] if line.kind else ["broken_word"] * line.broken + ["misread"] * any(line.wrong)
                rows += [{"region_id": x["region_id"], "line_id": x["line_id"], "noise": k} for k in kinds]
            out.append(rows)
        return pd.Series(out)

    rows = context.select("rec_id", F.inline(found("lines", "titles", "expected", "before", "following", "lexicon")))
    return rows.select("rec_id", "region_id", "line_id", "noise")


def corrected(token: str, lexicon: Lexicon) -> str:
    """A misread token as the most frequent known word in reach, its case and outer punctuation kept; else the token as it is."""
    word = core(token)
    bare = re.sub(r"[^\w'’-]|(?<=[^\W\d_])['’](?=[^\W\d_]{3})", "", word.translate(DIGITS) if any(c.isalpha() for c in word) else word).lower()
    known = bare != word.lower() and lexicon.count(bare) >= KNOWN
    reach = [(bare, True)] if known else lexicon.near(bare) or lexicon.near(word.lower())
    if not reach:
        return token
    best = max(reach, key=lambda x: (x[1], lexicon.count(x[0]), x[0]))[0]
    if word[:1].isupper():
        best = best[:1].upper() + best[1:]
    at = token.find(word)
    return token[:at] + best + token[at + len(word) :]


class Piece(NamedTuple):
    """A part of a page: text, whether it ends a sentence, what a paragraph boundary after it costs, and whether it is a block of its own (a heading, numbers)."""

    text: str
    ends: bool
    cost: float
    block: bool


_STOP = re.compile(r"[.!?…][»”\"')\]]*$")
_NO_STOP = re.compile(r"\d\.$|(?<!\w)[^\W\d_]\.$")


def pieces_of(decoded: list[Line]) -> list[Piece]:
    """The sentences of a page, repaired, the last one perhaps open; lines that stand between those of the text are blocks."""
    text = [x for x in decoded if not x.kind]
    widths = sorted(sum(map(len, x.tokens)) + len(x.tokens) for x in text)
    usual = widths[len(widths) // 2] if widths else 0
    out: list[Piece] = []
    words: list[str] = []
    blocks: list[Piece] = []  # those that wait for the end of a sentence
    held: list[str] = []

    def close(ends: bool, cost: float) -> None:
        if words:
            out.append(Piece(" ".join(words), ends, cost, False))
            words.clear()
        out.extend(blocks)
        blocks.clear()

    def shut() -> None:
        if held:
            blocks.append(Piece(" ".join(held), True, 0.0, True))
            held.clear()
        if not words:
            close(True, 0.0)

    for x in text:
        if interrupts(" ".join(x.tokens)):
            held += x.texts
            continue
        shut()
        # A boundary costs little after a short last line.
        short = sum(map(len, x.tokens)) + len(x.tokens) < 0.75 * usual
        for n, t in enumerate(x.texts):
            if t:
                words.append(t)
            if t and _STOP.search(t) and not _NO_STOP.search(t):
                last = not any(x.texts[n + 1 :])
                close(True, 0.2 if last and short else 1.0 if last else 2.0)
    shut()
    close(False, 4.0)
    return out


def boundaries(costs: list[float], scans: list[int], usual: int = 6, reach: int = 4) -> list[int]:
    """Sentences after the first that begin a paragraph, by dynamic programming.

    A boundary before sentence k costs costs[k] (less than nothing where there has to
    be one), a paragraph of n sentences ((n - usual) / usual) squared. A paragraph
    has at most 4 * usual sentences and its sentences begin on at most ``reach``
    scans after its first.
    """
    n = len(costs)
    if n < 2:
        return []
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end - 1, max(-1, end - 4 * usual - 1), -1):
            if scans[end - 1] - scans[start] > reach:
                break
            size = ((end - start - usual) / usual) ** 2
            cost = best[start] + (costs[start] if start else 0.0) + size
            if cost < best[end]:
                best[end], back[end] = cost, start
    out, at = [], n
    while back[at]:
        at = back[at]
        out.append(at)
    return out[::-1]


#: Scans whose paragraphs are set together; a paragraph begins with the first sentence of each such group.
GROUP = 16
#: What a boundary costs where a block stands between two sentences.
_FORCED = -100.0


def paragraphs_of(pages_: list[tuple[int, list[Piece]]], group: int) -> list[tuple[int, int, str]]:
    """(scan number, paragraph, text) of the paragraphs of a group of ``GROUP`` scan numbers.

    pages_: the pages of the group with the one before it and the six after it. A sentence belongs to the scan on which it begins. It goes on
    over a page's end, and past blocks, which stand behind it; a page without a
    sentence's end ends its sentence. Group after group decides alike which sentence
    is the first of a group.
    """
    first, beyond = group * GROUP, (group + 1) * GROUP
    sentences: list[list] = []  # scan, text, cost of a boundary after it, whether it is a block
    held: list[list] = []
    open_ = False
    before = None
    for number, own in sorted(pages_, key=lambda x: x[0]):
        if before is not None and number != before + 1:
            open_ = False
        before = number
        sentences += held if not open_ else []
        held = held if open_ else []
        for p in own:
            if p.block:
                (held if open_ else sentences).append([number, p.text, _FORCED, True])
                continue
            if open_:
                last = next(x for x in reversed(sentences) if not x[3])
                last[1] += " " + p.text
                last[2] = p.cost
            else:
                sentences.append([number, p.text, p.cost, False])
            open_ = not p.ends
            if not open_:
                sentences += held
                held = []
        if not any(p.ends and not p.block for p in own):
            open_ = False
    sentences += held
    # The page before gives only what goes on from it; the first sentence beyond the group ends it.
    own = [x for x in sentences if x[0] >= first]
    own = own[: next((k for k, x in enumerate(own) if x[0] >= beyond), len(own))]
    costs = [0.0] + [_FORCED if b[3] else a[2] for a, b in zip(own, own[1:])]
    starts = [0, *boundaries(costs, [x[0] for x in own]), len(own)] if own else []
    out: list[tuple[int, int, str]] = []
    numbers: Counter = Counter()
    for a, b in zip(starts, starts[1:]):
        number = own[a][0]
        out.append((number, numbers[number], " ".join(x[1] for x in own[a:b])))
        numbers[number] += 1
    return out


def paragraphs(scans: DataFrame) -> DataFrame:
    """volume, scan_number, paragraph, text: the repaired text of each volume in paragraphs.

    scan_number and paragraph (from 0) say where the paragraph begins; of several
    deliveries of a scan the first is read, records without a scan number stand for
    themselves. Titles, page numbers and margin notes are left out, words joined and
    divided, misread words set right where a known word is in reach. Headings and
    lines of bare numbers are paragraphs of their own behind the sentence they
    stand in.
    """
    paged = cut(pages(scans))
    context, lexicon = _with_lexicon(paged, _with_context(paged))

    @F.pandas_udf("array<struct<text:string,ends:boolean,cost:double,block:boolean>>")
    def pieces(lines: pd.Series, titles: pd.Series, expected: pd.Series, before: pd.Series, following: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for ls, hs, e, b, f, p in zip(lines, titles, expected, before, following, part):
            decoded = decode([x["text"] for x in ls], list(hs), None if pd.isna(e) else int(e), b or None, f or None, lexicon(p))
            out.append([x._asdict() for x in pieces_of(decoded)])
        return pd.Series(out)

    @F.pandas_udf("array<struct<scan_number:int,paragraph:int,text:string>>")
    def set_out(groups: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for group, own in zip(groups, rows):
            found = paragraphs_of([(int(r["scan_number"]), [Piece(p["text"], bool(p["ends"]), float(p["cost"]), bool(p["block"])) for p in r["p"]]) for r in own], int(group))
            out.append([{"scan_number": n, "paragraph": k, "text": t} for n, k, t in found])
        return pd.Series(out)

    first = paged.groupBy("volume", "scan_number", F.when(F.col("scan_number").isNull(), F.col("rec_id")).alias("_vf_solo")).agg(F.min("rec_id").alias("_vf_first"))
    decoded = context.join(first.select("_vf_first"), F.col("rec_id") == F.col("_vf_first"), "left_semi")
    decoded = decoded.select("rec_id", "volume", "scan_number", pieces("lines", "titles", "expected", "before", "following", "lexicon").alias("p"))
    number = F.coalesce("scan_number", F.lit(0))
    solo = F.when(F.col("scan_number").isNull(), F.col("rec_id"))
    block = lambda shift: F.floor((number + shift) / GROUP)
    rows = decoded.select("volume", solo.alias("solo"), number.alias("scan_number"), "p", F.explode(F.when(solo.isNull(), F.array_distinct(F.array(block(1), block(0), block(-6)))).otherwise(F.array(block(0)))).alias("block"))
    groups = rows.groupBy("volume", "solo", "block").agg(F.collect_list(F.struct("scan_number", "p")).alias("rows"))
    out = groups.select("volume", "solo", F.inline(set_out("block", "rows")))
    return out.select("volume", F.when(F.col("solo").isNull(), F.col("scan_number")).alias("scan_number"), "paragraph", "text")
