"""Recognised lines against a transcription: places of lines in the text, and how well they agree."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run that is matched without punctuation, at least; of a fuzzy run; share of it that has to agree.
RUN, FUZZY_RUN, FUZZY_SHARE, FUZZY_STRETCH = 3, 4, 0.5, 1.5


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def _bare(word: str) -> str:
    return re.sub(r"^\W+|\W+$", "", word).lower()


def tile(text: str, lines: list[str]) -> list[tuple[int, int, str] | None]:
    """(start, end, how) of each line in a text; places are taken once.

    Four matchers in turn, each at the first free place: the very text, its words
    whatever the space between them, its words without case and punctuation, and the
    free run of the text's words that agrees best (half of the line, four words at least,
    three of them in a row at its beginning).
    """
    taken: list[tuple[int, int]] = []
    words = _words(text)
    bare = [_bare(w) for w, *_ in words]

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken)

    def run(own: list[str], pool: list[str]) -> tuple[int, int] | None:
        n = len(own)
        for k in range(len(pool) - n + 1):
            if pool[k : k + n] == own and free(words[k][1], words[k + n - 1][2]):
                return words[k][1], words[k + n - 1][2]
        return None

    def fuzzy(own: list[str]) -> tuple[int, int] | None:
        best, n = None, len(own)
        # Places where the line's beginning stands; only stretches that hold one are compared.
        begins = {tuple(own[a : a + RUN]) for a in (0, 1) if a + RUN <= n}
        anchors = [k for k in range(len(bare) - RUN + 1) if tuple(bare[k : k + RUN]) in begins]
        for k in range(len(bare)):
            if bare[k] not in own[:2]:
                continue
            at = bisect_left(anchors, k)
            if at == len(anchors):
                break
            for m in range(n, int(n * FUZZY_STRETCH) + 1):
                if k + m > len(bare) or not free(words[k][1], words[k + m - 1][2]):
                    break
                if anchors[at] + RUN > k + m:
                    continue
                blocks = difflib.SequenceMatcher(None, own, bare[k : k + m], autojunk=False).get_matching_blocks()
                agreed = sum(b.size for b in blocks)
                share = agreed / n
                # The line has to begin where it says: three words in a row from its first or second word on.
                anchored = blocks[0].a <= 1 and blocks[0].size >= RUN
                if anchored and agreed >= FUZZY_RUN and share >= FUZZY_SHARE and (best is None or share > best[0]):
                    best = (share, words[k][1], words[k + m - 1][2])
        return best[1:] if best else None

    out: list[tuple[int, int, str] | None] = []
    for line in lines:
        line = (line or "").strip()
        own = [w for w, *_ in _words(line)]
        hit, how = None, ""
        if own:
            at = text.find(line)
            while at >= 0 and not free(at, at + len(line)):
                at = text.find(line, at + 1)
            if at >= 0:
                hit, how = (at, at + len(line)), "exact"
            if hit is None and (hit := run(own, [w for w, *_ in words])):
                how = "words"
            plain = [_bare(w) for w in own]
            if hit is None and len(own) >= RUN and (hit := run(plain, bare)):
                how = "plain words"
            if hit is None and len(own) >= FUZZY_RUN and (hit := fuzzy(plain)):
                how = "similar"
        if hit:
            taken.append(hit)
        out.append((*hit, how) if hit else None)
    return out


def tiled(pages: DataFrame) -> DataFrame:
    """key, line_idx, line, start, end, how, ratio of each line of a page.

    pages: key, text, lines (array of strings). The state of a page is its own, so a
    page is a row and there is no shuffle. Lines without a place have null start,
    how ``none`` and ratio 0; null texts and lines are empty ones.
    """

    @F.pandas_udf("array<struct<line_idx:int,line:string,start:int,end:int,how:string,ratio:double>>")
    def found(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, ls in zip(texts, lines):
            text, ls = text or "", [x or "" for x in (ls if ls is not None else [])]
            rows = []
            for k, (line, hit) in enumerate(zip(ls, tile(text, ls))):
                part = text[hit[0] : hit[1]] if hit else ""
                ratio = difflib.SequenceMatcher(None, " ".join(line.split()), " ".join(part.split()), autojunk=False).ratio() if hit else 0.0
                rows.append({"line_idx": k, "line": line, "start": hit[0] if hit else None, "end": hit[1] if hit else None, "how": hit[2] if hit else "none", "ratio": ratio})
            out.append(rows)
        return pd.Series(out)

    return pages.select("key", F.inline(found("text", "lines")))


def correction_status(scans: DataFrame, mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """scan, page, status: no_mapping, no_gt or mapping_attempted, by the scan's page and the page's transcription."""
    pages = mapping.select(F.col("scan").alias("_vf_s"), "page")
    texts = truth.where(F.trim("text") != "").select(F.col("page").alias("_vf_p")).distinct()
    joined = scans.join(pages, F.col("scan") == F.col("_vf_s"), "left").join(texts, F.col("page") == F.col("_vf_p"), "left")
    status = F.when(F.col("page").isNull(), "no_mapping").when(F.col("_vf_p").isNull(), "no_gt").otherwise("mapping_attempted")
    return joined.select(*scans.columns, "page", status.alias("status"))


def agreement(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, n_lines, n_placed, mean_ratio, covered (characters), share_placed of tiled lines."""
    out = lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("start").isNotNull()).alias("n_placed"), F.avg("ratio").alias("mean_ratio"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered")
    )
    return out.withColumn("share_placed", F.col("n_placed") / F.col("n_lines"))


def line_of(spans: DataFrame, texts: DataFrame, key: str, at: str = "start") -> DataFrame:
    """Spans with ``line_idx``, the number of line breaks before their start."""
    known = texts.select(F.col(key).alias("_vf_k"), F.col("text").alias("_vf_t"))
    head = F.substring(F.col("_vf_t"), F.lit(1), F.col(at))
    return spans.join(known, F.col(key) == F.col("_vf_k")).withColumn("line_idx", F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).drop("_vf_k", "_vf_t")


def sequence(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, text: lines joined by line breaks in order."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "\n").alias("text"))


