"""Chunking records: one chunk for each field, fixed windows, or one text for a record.

All of it is built-in functions on arrays: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Corpus

MAX_CHARS, OVERLAP = 2000, 200


@dataclass(frozen=True)
class Chunker:
    fields: tuple[str, ...]
    mode: str = "by_field"
    max_chars: int = MAX_CHARS
    overlap: int = OVERLAP
    metadata: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("by_field", "by_size"):
            raise ValueError(f"unknown chunker mode {self.mode!r}")
        if not self.fields:
            raise ValueError("a chunker needs fields")
        if self.max_chars <= 0 or not 0 <= self.overlap < self.max_chars:
            raise ValueError("overlap must be at least 0 and below max_chars")

    @staticmethod
    def of(corpus: Corpus) -> Chunker:
        spec = corpus.index.get("chunker") or {}
        return Chunker(tuple(spec.get("fields") or corpus.with_role("search")), spec.get("mode", "by_field"), int(spec.get("max_chars", MAX_CHARS)), int(spec.get("overlap", OVERLAP)), tuple(corpus.with_role("filter", "facet")))

    def chunks(self, records: DataFrame) -> DataFrame:
        """``chunk_id, record_id, chunk_field, chunk_idx, text, provenance, media_ref, metadata``.

        ``records`` has id, provenance and the struct ``fields``. ``chunk_idx`` counts the
        chunks of a record, over all its fields.
        """
        kinds = records.schema["fields"].dataType
        entries = []
        for f in self.fields:
            if f not in kinds.names:
                continue
            text = F.array_join(parts(F.col(f"fields.{f}"), kinds[f].dataType), "\n")
            texts = F.array(text) if self.mode == "by_field" else windows(text, self.max_chars, self.overlap)
            entries.append(F.transform(texts, _named(f)))
        if not entries:
            raise ValueError("none of the chunker's fields is in the records")
        every = F.filter(F.flatten(F.array(*entries)), lambda x: x["text"] != "")
        meta = [F.col(f"fields.{m}").alias(m) for m in self.metadata if m in kinds.names]
        flat = records.select(F.col("id").alias("record_id"), "provenance", (F.struct(*meta) if meta else F.lit(None)).alias("metadata"), F.posexplode(every).alias("chunk_idx", "c"))
        return flat.select(F.concat_ws("::", "record_id", "c.chunk_field", "chunk_idx").alias("chunk_id"), "record_id", "c.chunk_field", "chunk_idx", "c.text", "provenance", F.col("provenance.media_ref").alias("media_ref"), "metadata")


def _named(name: str):
    return lambda t: F.struct(F.lit(name).alias("chunk_field"), t.alias("text"))


def _flat(kind: T.StructType):
    return lambda x: struct_text(x, kind)


def parts(value: Column, kind: T.DataType) -> Column:
    """The texts of a field value: items of a list, or the scalar; blank ones are left out."""
    items = value.cast("array<string>") if isinstance(kind, T.ArrayType) else F.array(value.cast("string"))
    return F.coalesce(F.filter(items, lambda x: F.regexp_replace(x, r"\s", "") != ""), F.array().cast("array<string>"))


def windows(text: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, until one reaches the end."""
    step = size - overlap
    more = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), more), lambda i: F.substring(text, i * step + 1, size))).otherwise(F.array().cast("array<string>"))


def struct_text(x: Column, kind: T.StructType) -> Column:
    """A struct as text: term and explanation, name and purpose, else its values with blanks."""
    names = kind.names
    if "term" in names:
        return F.concat_ws(": ", x["term"], x["explanation"]) if "explanation" in names else x["term"]
    if "name" in names and "purpose" in names:
        return F.concat_ws(" — ", x["name"], x["purpose"])
    return F.concat_ws(" ", *(F.nullif(x[n].cast("string"), F.lit("")) for n in names))


def document_text(records: DataFrame, fields: list[str]) -> Column:
    """One text for a record: the fields' parts in order, joined by line breaks, stripped."""
    kinds = records.schema["fields"].dataType
    arrays = []
    for f in fields:
        if f in kinds.names:
            kind, value = kinds[f].dataType, F.col(f"fields.{f}")
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                value, kind = F.transform(value, _flat(kind.elementType)), T.ArrayType(T.StringType())
            arrays.append(parts(value, kind))
    if not arrays:
        return F.lit("")
    return F.regexp_replace(F.array_join(F.flatten(F.array(*arrays)), "\n"), r"^\s+|\s+$", "")
