"""Porting flat records of an older layout into the engine's raw shape, and reconciling the result.

``legacy_raw`` shapes flat records as an adapter would deliver them, so that the contract's mapping
reads them; ``ported`` joins what was ingested, carried forward and ported, checks it against the
reference list and puts it into that list's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import flatten_concepts, flatten_resources
from ..operators.ingest import in_reference_order, reconciled

#: The raw names of metadata columns, and the analysis columns that keep their names.
METADATA = {"id": "post_id", "shortCode": "shortcode", "ownerUsername": "owner", "caption": "caption", "hashtags": "tags"}
ANALYSIS = ("summary", "transcript", "workflow_steps", "tips", "concepts", "tools_apps", "value_score", "content_type", "domains", "is_educational", "gated_content", "gated_trigger", "is_promo")


def legacy_raw(records: DataFrame) -> DataFrame:
    """``seq, metadata, analysis, resources, resources_text, media, dataset_post_dir, extraction_status``.

    ``records`` has ``seq`` and the flat columns; those it lacks come out null. Concepts and resources
    given as structs are flattened to text; ``extraction_status`` falls back to pending.
    """
    have = {f.name: f.dataType for f in records.schema.fields}

    def column(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("string")
        kind = have[name]
        structs = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        return flatten_concepts(F.col(name)) if name == "concepts" and structs else F.col(name)

    def inside(name: str) -> Column:
        kind = have.get("provenance")
        return F.col(f"provenance.{name}") if isinstance(kind, T.StructType) and name in kind.names else F.lit(None).cast("string")

    metadata = F.struct(*(column(c).alias(n) for n, c in METADATA.items()))
    analysis = F.struct(*(column(c).alias(c) for c in ANALYSIS), inside("extracted_at").alias("analysed_at"), inside("extractor_model").alias("extractor_model"), inside("confidence").alias("confidence"))
    of_structs = "resources" in have and isinstance(have["resources"], T.ArrayType) and isinstance(have["resources"].elementType, T.StructType)
    text = flatten_resources(F.col("resources")) if of_structs else F.lit(None).cast("string")
    media = F.coalesce("media_files", F.array().cast("array<string>")) if "media_files" in have else F.array().cast("array<string>")
    status = F.coalesce("extraction_status", F.lit("pending")) if "extraction_status" in have else F.lit("pending")
    return records.select("seq", metadata.alias("metadata"), analysis.alias("analysis"), column("resources").alias("resources"), text.alias("resources_text"), media.alias("media"), F.coalesce(inside("media_ref"), F.lit("")).alias("dataset_post_dir"), status.alias("extraction_status"))


def ported(reference: DataFrame, ingested: DataFrame, mapped: DataFrame, order: str = "seq") -> DataFrame:
    """The final records in the reference's order: ingested ones first, then those of ``mapped`` that
    no ingested record has. ``reference`` has id and ``order``; both others have id and the same columns.

    Fails where the result lacks an id of the reference, has another one, or has one twice."""
    rest = mapped.join(ingested.select("id"), "id", "left_anti").join(reference.select("id"), "id", "left_semi")
    final = ingested.unionByName(rest)
    return in_reference_order(reconciled(reference.select("id").distinct(), final), reference, order=order)
