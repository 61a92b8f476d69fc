"""Sources: adapters give raw DataFrames; scans for records, gold questions and line-wise JSON.

An adapter is ``(spark, SourceSpec) -> DataFrame`` with a ``seq bigint`` in source order.
Register others in a dict and pass it along.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import SourceSpec
from ..errors import AdapterError
from ..session import staged

_TEXT_LISTS = ("workflow_steps", "tips", "tools_apps", "domains")
#: The columns of the two files of a saved post.
METADATA_SCHEMA = "id string, shortCode string, ownerUsername string, hashtags array<string>, caption string"
_ANALYSIS_FIELDS = (
    "summary string, transcript string, workflow_steps array<string>, tips array<string>, concepts array<string>, tools_apps array<string>, domains array<string>, "
    "resources array<string>, value_score string, content_type string, is_educational string, gated_content string, gated_trigger string, is_promo string, extractor_model string, confidence double, analysed_at string"
)
ANALYSIS_SCHEMA = f"{_ANALYSIS_FIELDS}, analysis struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _ANALYSIS_FIELDS.split(', '))}>"


def _read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern).withColumn("_path", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, _path string")


def _post(path: Column) -> Column:
    """``dataset/post`` of a file path."""
    return F.regexp_extract(path, r"([^/]+/[^/]+)/[^/]+$", 1)


def _concept(x: Column) -> Column:
    """An object with term and explanation, held as JSON text, as ``term: explanation``."""
    term, why = F.get_json_object(x, "$.term"), F.get_json_object(x, "$.explanation")
    return F.when(x.startswith("{") & term.isNotNull() & why.isNotNull(), F.concat(term, F.lit(": "), why)).when(x.startswith("{") & term.isNotNull(), term).otherwise(x)


def _resource_line(x: Column) -> Column:
    name, purpose = F.get_json_object(x, "$.name"), F.get_json_object(x, "$.purpose")
    return F.regexp_replace(F.concat(F.coalesce(name, F.lit("")), F.lit(" — "), F.coalesce(purpose, F.lit(""))), r"^[ —]+|[ —]+$", "")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``seq`` 1, 2, ... by ``order``, which is total. No task sees all rows: they are sorted
    by ranges, counted for each range, and shifted by the sum of the counts before."""
    held = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = sorted(tuple(r) for r in held.groupBy("_part").count().collect())  # one row for each partition
    before, shifts = 0, []
    for part, n in sizes:
        shifts.append((part, before))
        before += n
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn("_at_", at).join(F.broadcast(shift), "_part").withColumn("seq", F.col("_at_").cast("bigint") + F.col("_shift")).drop("_part", "_shift", "_at_")


def saved_posts(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The tree ``<location>/<dataset>/<post>/`` with post_metadata.json, analysis.json and media.

    Posts without metadata are skipped; a malformed file ends the whole load when it is read.
    ``media_ref`` is snapshot/dataset/post where media exist, else empty.
    """
    if not spec.location:
        raise AdapterError(f"source {spec.name}: no location")
    root = spec.location
    if "://" not in root and not Path(root).is_dir():
        raise AdapterError(f"source {spec.name}: {root} does not exist")
    names = [f.strip().split(" ")[0] for f in METADATA_SCHEMA.split(",")]
    meta = _read(spark, f"{root}/*/*/post_metadata.json", METADATA_SCHEMA).select(F.struct(*names).alias("metadata"), _post(F.col("_path")).alias("post"))
    found = _read(spark, f"{root}/*/*/analysis.json", ANALYSIS_SCHEMA)
    keys = [f.strip().split(" ")[0] for f in _ANALYSIS_FIELDS.split(", ")]
    # A nested analysis comes first; the outer one only fills what it lacks.
    flat = {k: F.coalesce(F.col(f"analysis.{k}"), F.col(k)) for k in keys}
    flat["concepts"] = F.transform(flat["concepts"], _concept)
    lines = F.array_join(F.filter(F.transform(flat["resources"], _resource_line), lambda x: x != ""), "\n")
    analysis = found.select(_post(F.col("_path")).alias("post"), F.struct(*(c.alias(k) for k, c in flat.items())).alias("analysis"), F.when(lines != "", lines).alias("resources_text"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").where(~F.lower("path").endswith(".json"))
    media = files.groupBy(_post(F.col("path")).alias("post")).agg(F.array_sort(F.collect_set(F.element_at(F.split("path", "/"), -1))).alias("media"))
    joined = meta.join(analysis, "post", "left").join(media, "post", "left")
    has_media = F.coalesce(F.size("media"), F.lit(0)) > 0
    snapshot = spec.snapshot or ""
    return numbered(joined, ["post"]).select(
        "seq", "metadata", "analysis", "resources_text",
        F.coalesce("media", F.array().cast("array<string>")).alias("media"),
        F.when(has_media, F.concat_ws("/", F.lit(snapshot), "post") if snapshot else F.col("post")).otherwise("").alias("dataset_post_dir"),
        F.when(reduce(or_, (F.col(f"analysis.{k}").isNotNull() for k in keys)), "ok").otherwise("pending").alias("extraction_status"),
        F.col("analysis.resources").alias("resources"),
    )


def csv_rows(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A CSV file with a header; every column is a string."""
    if not spec.location:
        raise AdapterError(f"source {spec.name}: no location")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(spec.location)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return numbered(staged(placed, "csv-rows"), ["_file", "_block", "_at"]).drop("_file", "_block", "_at")


REGISTRY: dict[str, Callable[[SparkSession, SourceSpec], DataFrame]] = {"ig_saved": saved_posts, "csv": csv_rows}


def read_source(spark: SparkSession, spec: SourceSpec, registry: Mapping[str, Callable] | None = None) -> DataFrame:
    known = REGISTRY | dict(registry or {})
    if spec.adapter not in known:
        raise AdapterError(f"source {spec.name}: unknown adapter {spec.adapter!r}")
    return known[spec.adapter](spark, spec)


def canonical_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A JSON array of records; ``fields`` is the DDL of the record's fields.

    Without a provenance source it is ``canonical``, without media_ref it is empty. Of records
    with the same id all are kept here (see ``latest_by_id``).
    """
    shape = f"id string, content_hash string, provenance struct<source:string,media_ref:string,timestamp:string,extractor:string,confidence:double>, fields struct<{fields}>"
    rows = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path)
    p = F.col("provenance")
    return rows.withColumn("provenance", F.struct(F.coalesce(p["source"], F.lit("canonical")).alias("source"), F.coalesce(p["media_ref"], F.lit("")).alias("media_ref"), p["timestamp"].alias("timestamp"), p["extractor"].alias("extractor"), p["confidence"].alias("confidence")))


def latest_by_id(records: DataFrame, order: str) -> DataFrame:
    """The record store of a lookup: of each id the last by ``order``."""
    w = Window.partitionBy("id").orderBy(F.col(order).desc())
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; ``expected`` falls back to ``expected_post_ids``."""
    rows = spark.read.schema("question_id string, question string, mode string, difficulty string, expected array<string>, expected_post_ids array<string>").option("multiLine", True).json(path)
    mode = F.coalesce("mode", F.lit("search"))
    known = mode.isin("search", "abstain", "answer")
    return rows.select("question_id", "question", F.when(known, mode).otherwise(F.raise_error(F.concat(F.lit("unknown mode "), mode))).alias("mode"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("expected", "expected_post_ids", F.array().cast("array<string>")).alias("expected"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that are none are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def merged_posts(base: DataFrame, extra: DataFrame, key: str, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Both sides' rows by key: columns in ``overwrite`` from ``extra`` first, others from ``base`` first."""
    b, e = base.alias("b"), extra.alias("e")
    cols = list(dict.fromkeys([*base.columns, *extra.columns]))

    def pick(c: str) -> Column:
        sides = [f"e.{c}", f"b.{c}"] if c in overwrite else [f"b.{c}", f"e.{c}"]
        have = [F.col(s) for s in sides if c in (base.columns if s[0] == "b" else extra.columns)]
        return F.coalesce(*have).alias(c)

    return b.join(e, F.col(f"b.{key}") == F.col(f"e.{key}"), "full").select(*map(pick, cols))
