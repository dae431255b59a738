"""Language of documents and of their passages, by words first and character n-grams for unseen words.

A word that the model knows scores its log frequency in each language; an unseen
word falls back to its character n-grams, from the longest known down to single
letters. Sentences are scored, neighbours of one language make a passage, and each
answer carries a confidence.

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` for a
language, by a hash of the text). As labels may be wrong and documents mixed, the
sample's sentences are labelled anew by the model and it is fitted again.
Everything else reads all documents and their whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.session import spread

#: Labelled documents of a language that the model is fitted on, about.
SAMPLE = 800
#: Rounds of labelling the sample's sentences anew.
ROUNDS = 2
#: Words and n-grams of a language that the model keeps, most frequent first.
MAX_WORDS, MAX_GRAMS = 20_000, 30_000
LONGEST = 5
#: A sentence with fewer words takes the language of its neighbours.
LEAST_WORDS = 5
#: Independent words that a passage counts as at most, for its confidence.
EVIDENCE = 4.0

# Names and codes of the languages.
NAMES = {
    "nl": "nl nld dut nederlands nederlandsch dutch hollands hollandsch vlaams niederländisch néerlandais",
    "de": "de deu ger deutsch duits duitsch german allemand hoogduitsch",
    "fr": "fr fra fre français francais frans fransch french französisch",
    "en": "en eng english engels engelsch englisch anglais",
    "la": "la lat latin latijn latina latijnsch lateinisch",
}
# Words that give the model a start where few documents are labelled.
SEEDS = {
    "nl": "de het een en van in te dat die niet is was op met voor ik wy zyn den des ook maar by aan door naar uit werd zoo als om hier doch want",
    "de": "der die das und ist war nicht ich wir ein eine mit von zu den dem auf für sich auch als nach bei aus dass wurde aber doch denn uns",
    "fr": "le la les de des du et est était ne pas je nous un une dans en que qui sur avec pour mais par au aux se plus car où",
    "en": "the and of to in a is was that it he we i with for on as his at by which not but from this were had be us",
    "la": "et in est non ad cum sed quod qui quae ut ex ab de hic nobis nam sunt erat per quam atque enim ubi mihi inter apud",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
LANGUAGES = tuple(NAMES)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# A line broken inside a word, then any other line break that isn't the end of a paragraph.
_WRAP = re.compile(r"(?<=[^\W\d_])[-¬=⸗­][ \t]*\r?\n[ \t]*(?=[a-zà-ÿß])")
_BREAK = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_STOP = re.compile(r"(?<![\d.])(?<!\b[A-Za-z])(?<!\b[A-Z][a-z])[.!?…]+[»”\"')\]]*\s+(?=[«„“\"'(\[]*\s*[^\W\d_a-zà-ÿ])|\s+(?=«)|(?<=»)\s+")


def language_of(label: Column) -> Column:
    """The code that a label in any spelling names, null if it names none of the languages."""
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    plain = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.regexp_extract(plain, r"^([^\s_-]+)[_-]", 1)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points."""
    out, at = [], 0
    for part in [*_BREAK.finditer(text), None]:
        end = part.start() if part else len(text)
        start = at
        for stop in _STOP.finditer(text, at, end):
            if text[start : stop.end()].strip():
                out.append((start, stop.end()))
            start = stop.end()
        if text[start:end].strip():
            out.append((start, end))
        at = part.end() if part else end
    return out


def words(text: str) -> list[str]:
    return _WORD.findall(_WRAP.sub("", text).lower())


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language; ``score`` gives the vector of a word."""

    def __init__(self, word_counts: dict[str, Counter], languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        total = [sum(word_counts[c].values()) + 1 for c in languages]
        common = set()
        for c in languages:
            common |= {w for w, n in word_counts[c].most_common(MAX_WORDS) if n > 1}
        # Frequencies are smoothed with half an occurrence, so a word of one language doesn't rule out the rest.
        self.words = {
            w: tuple(math.log((word_counts[c][w] + 0.5) / t) for c, t in zip(languages, total)) for w in sorted(common)
        }
        grams = {c: Counter() for c in languages}
        for c in languages:
            for w, n in word_counts[c].items():
                for g in _grams(w):
                    grams[c][g] += n
        by_length = {c: Counter() for c in languages}
        for c in languages:
            for g, n in grams[c].items():
                by_length[c][len(g)] += n
        kept = set()
        for c in languages:
            kept |= {g for g, n in grams[c].most_common(MAX_GRAMS) if n > 2}
        self.grams = {
            g: tuple(math.log((grams[c][g] + 0.5) / (by_length[c][len(g)] + 1)) for c in languages) for g in sorted(kept)
        }

    def unseen(self, word: str) -> tuple[float, ...]:
        """Mean over the word's positions of the longest known n-gram that starts there; flattened, as it is weaker evidence."""
        w, rows = f" {word} ", []
        for i in range(len(w) - 1):
            for n in range(min(LONGEST, len(w) - i), 0, -1):
                known = self.grams.get(w[i : i + n])
                if known is not None:
                    rows.append(known)
                    break
        if not rows:
            return (0.0,) * len(self.languages)
        sums = [sum(x) / len(rows) for x in zip(*rows)]
        top = max(sums)
        return tuple(max(s - top, -1.5) for s in sums)


class Scorer:
    """A model with the vectors of the words met so far, as a matrix."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.ids = {w: i for i, w in enumerate(self.model.words)}
        self.rows = [self._clip(v) for v in self.model.words.values()]
        self.matrix = np.array(self.rows, dtype=np.float64).reshape(-1, len(self.model.languages))

    @staticmethod
    def _clip(v: tuple[float, ...]) -> tuple[float, ...]:
        top = max(v)
        return tuple(max(x - top, -6.0) for x in v)

    def score(self, parts: list[list[str]]) -> np.ndarray:
        """Summed log odds of lists of words: one row each."""
        if len(self.rows) > self.most:
            self._reset()
        ids, unseen, grown = self.ids, self.model.unseen, len(self.rows)
        flat, starts = [], []
        for ws in parts:
            starts.append(len(flat))
            for w in ws:
                i = ids.get(w)
                if i is None:
                    i = ids[w] = len(self.rows)
                    self.rows.append(unseen(w))
                flat.append(i)
        if len(self.rows) > grown:
            self.matrix = np.vstack([self.matrix, np.array(self.rows[grown:], dtype=np.float64)])
        out = np.zeros((len(parts), len(self.model.languages)))
        filled = [k for k, ws in enumerate(parts) if ws]
        if filled:
            out[filled] = np.add.reduceat(self.matrix[flat], [starts[k] for k in filled], axis=0)
        return out


def fit(labelled: list[tuple[str, str]], rounds: int = ROUNDS, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model of (language, text) rows; ties and rows of other languages do no harm."""
    parts = [(c, words(t[a:b])) for c, t in labelled if c in languages and t for a, b in sentences(t)]
    counts: dict[str, Counter] = defaultdict(Counter)
    for c, ws in parts:
        counts[c].update(ws)

    def seeded() -> Model:
        for c in languages:
            for w in SEEDS[c].split():
                counts[c][w] += 3
        return Model(counts, languages)

    model = seeded()
    for _ in range(rounds):
        scores = Scorer(model).score([ws for _, ws in parts])
        counts = defaultdict(Counter)
        for (c, ws), s in zip(parts, scores):
            counts[languages[int(s.argmax())] if len(ws) >= LEAST_WORDS else c].update(ws)
        model = seeded()
    return model


def fitted(documents: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model of the documents' own labels: about ``sample`` of each language, those whose ids have the lowest hashes.

    Only labels are counted; the texts are read once, and of equal texts of the
    sample one counts, so a text that fills a third of the rows does no harm. Twice
    the sample of all languages is the most that comes to the driver.
    """
    rows = documents.where(F.col(text).isNotNull()).select(language_of(F.col(lang)).alias("c"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("t")).where("c is not null")
    sizes = {r.c: r["count"] for r in documents.select(language_of(F.col(lang)).alias("c")).where("c is not null").groupBy("c").count().collect()}
    if not sizes:
        return fit([])
    # The hashes are even, so this part of their range holds about the sample.
    limits = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil((1 << 32) * min(1.0, sample / n)))])
    chosen = rows.where(F.shiftrightunsigned("h", 32) < limits[F.col("c")]).orderBy("h", "c", "t").limit(2 * sample * len(NAMES))
    return fit(sorted({(r.c, r.t) for r in chosen.collect()}))


_SCORERS: dict[tuple, Scorer] = {}

SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double,n_sentences:int>>"


def passages_of(texts: list[str | None], scorer: Scorer, least: int = LEAST_WORDS) -> list[list[tuple]]:
    """Of each text its passages (start, end, lang, confidence, n_sentences); [] without any word."""
    spans = [sentences(t) if t else [] for t in texts]
    flat = [words(t[a:b]) for t, ss in zip(texts, spans) if t for a, b in ss]
    scores, languages, at, out = scorer.score(flat), scorer.model.languages, 0, []
    for ss in spans:
        own, sizes = scores[at : at + len(ss)], [len(w) for w in flat[at : at + len(ss)]]
        at += len(ss)
        if not any(sizes):
            out.append([])
            continue
        best = [int(s.argmax()) if n >= least else -1 for s, n in zip(own, sizes)]
        if all(b < 0 for b in best):
            best = [int(own.sum(axis=0).argmax())] * len(ss)
        # Short sentences follow the one before, at the start the one after.
        for k, b in enumerate(best):
            if b < 0:
                best[k] = best[k - 1] if k else next(x for x in best if x >= 0)
        merged: list[list] = []
        for (a, e), b, s, n in zip(ss, best, own, sizes):
            if merged and merged[-1][2] == b:
                merged[-1][1] = e
                merged[-1][3] = merged[-1][3] + s
                merged[-1][4] += n >= least
                merged[-1][5] += n
            else:
                merged.append([a, e, b, s, int(n >= least), n])
        rows = []
        for a, e, b, s, k, n in merged:
            # Words of a passage aren't independent; their mean counts as so many words.
            p = np.exp((s - s.max()) * min(1.0, EVIDENCE / max(n, 1)))
            rows.append((a, e, languages[b], float(p[b] / p.sum()), k))
        out.append(rows)
    return out


def passages(documents: DataFrame, model: Model, text: str = "text", out: str = "passages") -> DataFrame:
    """Add ``out``: the passages of each text with language, confidence and number of whole sentences.

    start and end are code points. A null text gives null, a text without words an
    empty array. No shuffle; the model is broadcast (at most
    ``MAX_WORDS + MAX_GRAMS`` entries for a language).
    """
    spark = documents.sparkSession
    documents = spread(documents)
    shared = spark.sparkContext.broadcast((model.languages, model.words, model.grams))
    key = (spark.sparkContext.applicationId, shared._jbroadcast.id())

    @F.pandas_udf(SEGMENTS)
    def found(texts: pd.Series) -> pd.Series:
        if key not in _SCORERS:
            _SCORERS.clear()
            m = Model.__new__(Model)
            m.languages, m.words, m.grams = shared.value
            _SCORERS[key] = Scorer(m)
        values = [None if t is None else t for t in texts]
        rows = passages_of(values, _SCORERS[key])
        names = ("start", "end", "lang", "confidence", "n_sentences")
        return pd.Series([None if t is None else [dict(zip(names, r)) for r in own] for t, own in zip(values, rows)])

    return documents.withColumn(out, found(F.col(text)))


def languages(documents: DataFrame, model: Model | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """All input columns, then ``declared`` (code of the label or null), ``passages``, ``held`` (the languages with
    a whole sentence), ``found`` (the main language), ``confidence`` and ``wrong`` (the label is missing, no
    language or not the text's, or the text holds several languages).

    A document without any word has found null, held empty and wrong false. Columns
    with names of these are replaced.
    """
    model = model or fitted(documents, text=text, lang=lang)
    df = passages(documents, model, text)
    whole = F.filter("passages", lambda p: p["n_sentences"] > 0)
    held = F.array_distinct(F.transform(F.when(F.size(whole) > 0, whole).otherwise(F.col("passages")), lambda p: p["lang"]))
    longest = F.reduce(
        "passages",
        F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence")),
        lambda best, p: F.when(p["end"] - p["start"] > best["n"], F.struct((p["end"] - p["start"]).alias("n"), p["lang"].alias("lang"), p["confidence"].alias("confidence"))).otherwise(best),
    )
    df = df.withColumn("declared", language_of(F.col(lang))).withColumn("held", held).withColumn("_vf_long", longest)
    df = df.withColumn("found", F.col("_vf_long.lang")).withColumn("confidence", F.col("_vf_long.confidence")).drop("_vf_long")
    several = F.size("held") > 1
    other = F.col("declared").isNull() | ~F.array_contains("held", F.col("declared"))
    return df.withColumn("wrong", F.coalesce((F.size("held") > 0) & (several | other), F.lit(False)))
