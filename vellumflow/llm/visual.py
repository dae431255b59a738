"""One consistent form for text that looks the same but differs in its characters.

Quick-check properties say of each character whether it can change under
normalization; only the runs of such unstable characters, with the stable starter
before them (which a mark may join), are normalized and spliced back into the
otherwise unchanged text. Values without an unstable character never leave the JVM.

Plain form: composed characters (NFC); Latin letters of ordinary width, without
ligatures and font variants; the ordinary space and hyphen; nothing invisible; no
letter of another script standing in for a Latin one it looks like (or the other
way round in a word of the other script). A value wholly in another script keeps
its letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKES = dict(
    zip(
        "АВЕЗКМНОРСТУХЅІЈҺԀԚԜаеорсухѕіјһԁԛԝүѵӏ"
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ"
        "ՏՍՕօոսհցզ",
        "ABE3KMHOPCTYXSIJHDQWaeopcyxsijhdqwyvl"
        "ABEZHIKMNOPTYXCjovc"
        "SUOonuhgq",
    )
)
del LOOK_ALIKES["З"]
# Hyphens and minus signs that look like the ordinary hyphen.
HYPHENS = "‐‑‒−﹣－˗⁃"
# What is invisible beside format and control characters.
INVISIBLE = [
    (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
]

_TO_OTHER: dict[str, dict[str, str]] = {}
for _other, _latin in LOOK_ALIKES.items():
    _TO_OTHER.setdefault(unicodedata.name(_other).split()[0], {}).setdefault(_latin, _other)


def _is_invisible(ch: str) -> bool:
    return (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\v\f\r\x85") or any(
        a <= ord(ch) <= b for a, b in INVISIBLE
    )


def _folded(ch: str) -> str:
    """The plain rendering of one character, apart from look-alike letters."""
    if _is_invisible(ch):
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in "\t\n\v\f\r\x85" or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    tag, _, _ = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>"):
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and ch != "ſ":
        plain = unicodedata.normalize("NFKC", ch)
        if plain.isalpha() and "LATIN" in unicodedata.name(ch, ""):
            return plain
    return ch


def _look_alike(ch: str) -> bool:
    return unicodedata.normalize("NFD", ch)[0] in LOOK_ALIKES


@lru_cache(1)
def _classes() -> tuple[re.Pattern, dict[str, str], str]:
    """The pattern of unstable segments, the foldings, and the unstable class as text."""
    # Ideographs, syllables, surrogates and private use are stable; beyond plane 1 only compatibility ideographs and tags aren't.
    stable = [range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0xD800, 0xF900), range(0x20000, 0x2F800), range(0x2FA20, 0xE0000), range(0xE1000, sys.maxunicode + 1)]
    skip = {r.start: r.stop for r in stable}
    looked, c = [], 0
    while c <= sys.maxunicode:
        if c in skip:
            c = skip[c]
            continue
        if not 0x20 <= c < 0x7F:
            looked.append(chr(c))
        c += 1
    joins_back = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]} | {
        unicodedata.normalize("NFD", ch)[-1] for ch in looked if unicodedata.decomposition(ch)[:1] not in ("", "<")
    }
    joins_back = {ch for ch in joins_back if not unicodedata.decomposition(ch) and not ch.isalpha() or "HANGUL" in unicodedata.name(ch, "")}
    folds, unstable = {}, []
    for ch in looked:
        c = ord(ch)
        if unicodedata.category(ch) in ("Cn", "Co") and not _is_invisible(ch):
            continue
        plain = _folded(ch)
        if plain != ch:
            folds[ch] = plain
        if (
            plain != ch
            or unicodedata.combining(ch)
            or ch in joins_back
            or not unicodedata.is_normalized("NFC", ch)
            or _look_alike(ch)
        ):
            unstable.append(c)
    ranges: list[list[int]] = []
    for c in unstable:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    members = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in ranges)
    return re.compile(f"[^{members}]?[{members}]+", re.S), folds, members


# Letters of the scripts that have look-alikes of Latin letters.
_OTHER = re.compile(r"[\u0370-\u03ff\u0400-\u052f\u0530-\u058f]")


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def _words_fixed(text: str) -> str:
    """Look-alike letters of a folded text set right, by words; only words with a letter of another script change."""
    if not any(_script(c) == "LATIN" for c in text if c.isalpha()):
        return text

    def word(m: re.Match) -> str:
        if not _OTHER.search(m[0]):
            return m[0]
        w = unicodedata.normalize("NFD", m[0])
        own = [c for c in w if c.isalpha()]
        firm = [c for c in own if _script(c) != "LATIN" and c not in LOOK_ALIKES]
        if not firm:
            return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in w))
        back = _TO_OTHER.get(_script(firm[0]), {})
        if all(c in back for c in own if _script(c) == "LATIN"):
            return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in w))
        return m[0]

    return re.sub(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*", word, text)


def _plain(text: str) -> str:
    pattern, folds, _ = _classes()
    spliced = pattern.sub(lambda m: unicodedata.normalize("NFC", "".join(folds.get(c, c) for c in m[0])), text)
    return _words_fixed(spliced) if _OTHER.search(spliced) else spliced


_plain_known = lru_cache(100_000)(_plain)


def plain(text: str) -> str:
    """The plain form of a text; short values are remembered."""
    return _plain_known(text) if len(text) <= 100 else _plain(text)


#: What no value in plain form needs to be looked at for: ASCII and the composed letters of Latin-1 and Latin Extended-A.
_STABLE = r"^[ -~¡-¬®-ıĴ-ľŁ-ňŊ-žƀ]*\z"


@F.pandas_udf(StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else plain(v))


def plain_form(value: Column) -> Column:
    """The plain form of a string column; null stays null, the empty text stays empty.

    Only values with a character outside the quick-check class go through Python.
    """
    unstable = ~value.rlike(_STABLE)
    return F.coalesce(_plain_udf(F.when(unstable, value)), value)


def normalized(df: DataFrame, columns: list[str], suffix: str = "_plain") -> DataFrame:
    """Add ``<column><suffix>`` for each column; columns of these names are replaced."""
    return df.withColumns({f"{c}{suffix}": plain_form(F.col(c)) for c in columns})


def not_plain(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, value, plain: each value that isn't in plain form.

    Nulls are no values; the order of rows is free; an empty table gives an empty
    table.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.col(key), F.inline(fields)).where(F.col("value").isNotNull() & ~F.col("value").rlike(_STABLE))
    return long.withColumn("plain", plain_form(F.col("value"))).where(F.col("plain") != F.col("value"))
