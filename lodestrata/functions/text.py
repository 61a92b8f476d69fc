"""Text functions as Columns: index tokens and content tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no content.
STOPWORDS = frozenset(
    """a an and are as at be but by for from has have how i in is it its of on
    or that the this to was what when where which who why will with you your
    do does did can could should would""".split()
)

_ACCENTED = [(chr(c), d) for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)]
_FROM, _TO = "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED)


def folded(text: Column) -> Column:
    """Lower case, Latin accents and combining marks dropped."""
    low = F.lower(text)
    plain = F.octet_length(low) == F.length(low)  # ASCII has nothing to fold
    return F.when(plain, low).otherwise(F.regexp_replace(F.translate(low, _FROM, _TO), r"\p{Mn}", ""))


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order; ``_`` and ``-`` separate."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


_WORD = re.compile(r"\w+")


def content_words(text: str | None) -> list[str]:
    """Compatibility-composed, case-folded words without stopwords; repeated words stay."""
    return [w for w in _WORD.findall(unicodedata.normalize("NFKC", text or "").casefold()) if w not in STOPWORDS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def content_tokens(text: pd.Series) -> pd.Series:
    """``content_words`` over Arrow batches; Spark has neither NFKC nor case folding."""
    return text.map(content_words)


def coverage_ratio(query: Column, document: Column) -> Column:
    """Share of the query's tokens (repeated ones count) that the document's tokens hold; 1 for a
    query without tokens, 0 without a document."""
    hit = F.size(F.filter(query, lambda t: F.array_contains(document, t)))
    return F.when(F.size(query) == 0, 1.0).when(document.isNull(), 0.0).otherwise(hit / F.size(query))
