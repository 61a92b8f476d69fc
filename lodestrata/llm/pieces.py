"""Splitting oversized texts at natural boundaries with balanced targets (problem 1).

For a text of n characters above the limit the least number of pieces that could hold it is
tried first. Equal-length targets are laid over the text, each cut is moved to the strongest
boundary near its target (paragraph, then sentence, then word end; the nearest of the same
strength), and where a piece breaks the limit one more piece is tried. The next piece begins
at the first word start within the overlap before the cut. Only a text without any boundary in
reach is cut inside a word, and then not within a grapheme where this can be avoided.

Only offsets are computed in Python; pieces are cut out by Spark. Lengths and offsets are code
points. Consecutive pieces overlap or touch, so every character is in a piece.

Defined cases: null and empty texts have no piece; texts up to the limit have none unless
``keep_small``; repeated rows give repeated pieces; other columns are carried along.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_PARAGRAPH = re.compile(r"(?:\r?\n)(?:[ \t]*\r?\n)*")
_SENTENCE = re.compile(r"[.!?…。！？؟।]+[\"'”’»)\]]*(?=\s)|[。！？]")
_SPACE = re.compile(r"\s+")


def _inside_grapheme(text: str, at: int) -> bool:
    c, before = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in "‍︎️" or before == "‍" or 0x1F3FB <= ord(c) <= 0x1F3FF


def _nearest(cuts: list[int], low: int, high: int, target: int) -> int | None:
    """The entry of sorted ``cuts`` in [low, high] nearest to the target, the later at a tie."""
    i, j = bisect_left(cuts, low), bisect_right(cuts, high)
    if i >= j:
        return None
    k = bisect_left(cuts, target, i, j)
    near = [cuts[x] for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda c: (abs(c - target), -c))


def spans(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """Half-open offsets of the pieces of one text."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text)]
    sentences = [m.end() for m in _SENTENCE.finditer(text)]
    spaces = [(m.start(), m.end()) for m in _SPACE.finditer(text)]
    words, starts = [a for a, _ in spaces if a], [b for _, b in spaces if b < n]
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        step = (n - overlap) / count
        reach = max(1, int(min(step / 2, limit / 5)))
        out, start = [], 0
        for i in range(1, count):
            target = min(int(overlap + step * i), start + limit)
            low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
            cut = None
            if low <= high:
                for kind in (paragraphs, sentences, words):
                    if (cut := _nearest(kind, low, high, target)) is not None:
                        break
            if cut is None:
                cut = _nearest(words, start + overlap + 1, min(start + limit, n - 1), target)
            if cut is None:
                cut = max(start + overlap + 1, min(target, start + limit))
                back = cut
                while back > start + overlap + 1 and cut - back < 32 and _inside_grapheme(text, back):
                    back -= 1
                if not _inside_grapheme(text, back):
                    cut = back
            if cut >= n:
                break
            out.append((start, cut))
            k = bisect_left(starts, cut - overlap)
            start = starts[k] if k < len(starts) and starts[k] <= cut else cut - overlap
        out.append((start, n))
        if all(b - a <= limit for a, b in out):
            return out
        count += 1


def split_oversized(df: DataFrame, text: str = "text", limit: int = 2000, overlap: int = 200, keep_small: bool = False) -> DataFrame:
    """Rows of ``df`` once for each piece, with ``piece_no``, ``n_pieces``, ``start_char``,
    ``end_char``, ``overlap_chars`` (shared with the piece before) and ``piece``.

    ``overlap`` must be less than half of ``limit``. Input columns of these names are replaced.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half of the limit")
    ship(df.sparkSession)

    def ends(texts: pd.Series) -> pd.Series:
        return pd.Series([[x for s in spans(t, limit, overlap) for x in s] if t else None for t in texts])

    # Marked so that the plan evaluates it once a row, however often the offsets are used.
    offsets = F.pandas_udf(ends, "array<int>").asNondeterministic()
    source = df.drop("piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "piece").where(F.length(text) > (0 if keep_small else limit))
    flat = source.withColumn("_offsets", offsets(F.col(text))).withColumn("n_pieces", (F.size("_offsets") / 2).cast("int"))
    each = flat.select("*", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    start, end = F.element_at("_offsets", F.col("piece_no") * 2 - 1), F.element_at("_offsets", F.col("piece_no") * 2)
    before = F.when(F.col("piece_no") > 1, F.element_at("_offsets", F.greatest(F.col("piece_no") * 2 - 2, F.lit(1))))
    return (
        each.withColumn("start_char", start).withColumn("end_char", end).withColumn("overlap_chars", F.coalesce(before - start, F.lit(0)))
        .withColumn("piece", F.col(text).substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
        .drop("_offsets")
    )
