"""Repetition inside single documents (problem 10): weak supervision over repetition rules.

One pass over the texts measures each document: the shares of its words that lie in five, eight
and thirteen consecutive words which also begin at an earlier word, the shares of repeated
sentences and lines, the share of its most frequent four-word sequence, the variety of its
words and how far it compresses. Rules turn each measure into a vote (repetitive, clean) or
abstain.

Expectation-maximisation estimates from the votes of all documents how reliable each rule is
and how common repetition is; no label is given. It needs only the number of documents for each
pattern of votes (at most 3 ** 8 patterns), so it runs over a summary of bounded size whatever
the corpus. A document is held repetitive by its posterior, not by passing every rule.

Words are the longest runs of letters and digits of the lower-cased text. Defined cases:
null, blank and wordless texts have share 0, all rules abstain and their posterior is null;
texts of fewer words than a rule needs get its abstention; repeated rows are each reported.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, staged
from .shingles import WordHasher, shingle_hashes, words_of
from .weak import estimate

#: Measure, votes "repetitive" from, votes "clean" up to, words needed to vote.
RULES = (
    ("repeated_share", 0.30, 0.10, 8),
    ("share_5", 0.30, 0.12, 8),
    ("share_13", 0.25, 0.05, 13),
    ("sentence_share", 0.25, 0.05, 20),
    ("line_share", 0.30, 0.05, 20),
    ("top_four_share", 0.15, 0.05, 20),
    ("sameness", 0.75, 0.50, 60),
    ("compression", 0.70, 0.60, 60),
)
_SENTENCE = re.compile(r"[.!?…。！？\n]+\s*")
_MEASURES = [r[0] for r in RULES]


def repeated_share(hashes: np.ndarray, run: int = 8) -> tuple[int, int]:
    """Repeated words and all words: a word is repeated if it lies in ``run`` consecutive words
    that also begin at an earlier word."""
    n = len(hashes)
    if n < run:
        return 0, n
    grams = shingle_hashes(hashes, run)
    _, first, which = np.unique(grams, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] < np.arange(len(grams)))
    if not len(again):
        return 0, n
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), n


def _again_share(parts: list[str]) -> float:
    """Share of the characters that lie in parts seen before."""
    seen, again, total = set(), 0, 0
    for p in parts:
        p = p.strip()
        if p:
            total += len(p)
            again += len(p) if p in seen else 0
            seen.add(p)
    return again / total if total else 0.0


def _top_share(sorted_grams: np.ndarray, n: int, words: int) -> float:
    if words < 4 * n:
        return 0.0
    edges = np.flatnonzero(np.diff(sorted_grams)) + 1
    most = np.diff(np.concatenate(([0], edges, [len(sorted_grams)]))).max()
    return min(1.0, n * int(most) / words) if most > 1 else 0.0


def _measure(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_repeated", *_MEASURES[1:])}
            for text in batch.column(1).to_pylist():
                h = hasher(words_of(text))
                n = len(h)
                rows["n_words"].append(n)
                if not n:
                    rows["n_repeated"].append(0)
                    for k in _MEASURES[1:]:
                        rows[k].append(None)
                    continue
                fours = np.sort(shingle_hashes(h, 4))
                # Where no four words repeat, no longer sequence does.
                again = n >= 4 and bool((fours[1:] == fours[:-1]).any())
                rows["n_repeated"].append(repeated_share(h, run)[0] if again or run < 4 else 0)
                for k in (5, 13):
                    rows[f"share_{k}"].append(repeated_share(h, k)[0] / n if again else 0.0)
                raw = text.encode("utf-8", "surrogatepass")
                rows["sentence_share"].append(_again_share(_SENTENCE.split(text)))
                rows["line_share"].append(_again_share(text.split("\n")) if "\n" in text else 0.0)
                rows["top_four_share"].append(_top_share(fours, 4, n) if again else 0.0)
                rows["sameness"].append(1 - len(set(h.tolist())) / n)
                rows["compression"].append(1 - min(1.0, len(zlib.compress(raw, 1)) / len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_repeated"], pa.int64()), *(pa.array(rows[k], pa.float64()) for k in _MEASURES[1:])], names=["id", *rows])

    return go


def measured(docs: DataFrame, run: int = 8) -> DataFrame:
    """The measures of each document (``id``, ``text``), whole texts."""
    ship(docs.sparkSession)
    shape = "id bigint, n_words bigint, n_repeated bigint, " + ", ".join(f"{k} double" for k in _MEASURES[1:])
    raw = docs.select(F.col("id").cast("bigint"), "text").mapInArrow(_measure(run), shape)
    return raw.withColumn("repeated_share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0))


def _vote(measure: str, high: float, low: float, least: int) -> Column:
    m = F.col(measure)
    return F.when(F.col("n_words") < least, 0).when(m >= high, 1).when(m <= low, -1).otherwise(0)


def repetition(docs: DataFrame, run: int = 8) -> DataFrame:
    """``id, n_words, n_repeated, repeated_share``, the other measures, the ``votes`` and
    ``p_repetitive``, the posterior that the document is repetitive."""
    m = staged(measured(docs, run), "repetition")
    votes = m.withColumn("votes", F.array(*(_vote(*r) for r in RULES)))
    table = votes.where("n_words > 0").groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows
    if not table:
        return votes.withColumn("p_repetitive", F.lit(None).cast("double"))
    patterns, counts = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    posterior, _, _ = estimate(patterns, counts)
    spark = docs.sparkSession
    known = spark.createDataFrame([([int(x) for x in v], float(p)) for v, p in zip(patterns, posterior)], "votes array<int>, p_repetitive double")
    out = votes.join(F.broadcast(known), "votes", "left")
    return out.withColumn("p_repetitive", F.when(F.col("n_words") > 0, F.col("p_repetitive")))
