"""Ingest: mapping, type checks, envelope, provenance, hashes, dedupe, incremental skip.

Everything up to dedupe is narrow; dedupe is one shuffle by key; the skip is one join with the
manifest. Errors are data: a row that fails becomes a gap (or ends the run under ``abort``).
In columns an absent value and a null are the same; both skip the transform.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import SPARK_TYPES, Corpus, FieldSpec, SourceSpec
from ..errors import DedupeError, PipelineError
from ..functions import transforms
from ..session import staged
from ..sources.adapters import read_source

POLICIES = ("keep_first", "newest", "highest_confidence", "version_append")
PROVENANCE = "struct<source:string,media_ref:string,timestamp:string,extractor:string,confidence:double>"


def dotted(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column behind a dotted path and its type; list segments are indexes (negative ones
    count from the end); null if the schema has no such path."""
    kind: T.DataType = schema
    col: Column | None = None
    for part in path.split("."):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            col, kind = (F.col(f"`{part}`") if col is None else col[part]), kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.lstrip("-").isdigit():
            i = int(part)
            col, kind = F.try_element_at(col, F.lit(i + 1 if i >= 0 else i)), kind.elementType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(part)), kind.valueType
        else:
            return None
    return col, kind


def checked(spec: FieldSpec, m: transforms.Mapped) -> tuple[Column, Column]:
    """Value and error of a mapped column against the declared type. Never coerces, except that
    an integer is a float."""
    want = SPARK_TYPES[spec.type]
    wrong = F.when(m.value.isNotNull(), F.lit(f"{spec.name}: not {spec.type}"))
    if spec.type in ("object", "list[object]"):
        text = m.value if isinstance(m.type, T.StringType) else F.to_json(m.value) if isinstance(m.type, (T.StructType, T.ArrayType, T.MapType)) else m.value.cast("string")
        return (m.value, m.error) if isinstance(m.type, T.ArrayType) and m.type == want else (text, m.error) if spec.type == "object" else (F.lit(None).cast(want), F.coalesce(m.error, wrong))
    integers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    fits = type(m.type) is type(want) or spec.type == "int" and isinstance(m.type, integers) or spec.type == "float" and isinstance(m.type, (*integers, T.FloatType))
    if isinstance(want, T.ArrayType) and isinstance(m.type, T.ArrayType):
        if isinstance(m.type.elementType, T.StringType):
            holes = F.when(F.exists(m.value, lambda x: x.isNull()), F.lit(f"{spec.name}: null in a list"))
            return m.value, F.coalesce(m.error, holes)
        if isinstance(m.type.elementType, T.NullType):
            return m.value.cast(want), m.error
        return F.lit(None).cast(want), F.coalesce(m.error, F.when(F.size(m.value) > 0, F.lit(f"{spec.name}: not {spec.type}")))
    if isinstance(m.type, T.NullType):
        return F.lit(None).cast(want), m.error
    return (m.value.cast(want), m.error) if fits else (F.lit(None).cast(want), F.coalesce(m.error, wrong))


def _has_text(kind: str, c: Column) -> Column:
    full = lambda x: F.regexp_replace(x, r"\s", "") != ""
    return F.coalesce(F.exists(c, lambda x: full(x)) if kind.startswith("list") else full(c.cast("string")), F.lit(False))


def content_hash(fields: Mapping[str, Column], refresh: tuple[str, ...] = ()) -> Column:
    """SHA-256 over canonical JSON of the fields in order of their names: all that are not null,
    or exactly the listed ones with their nulls."""
    names = sorted(refresh) if refresh else sorted(fields)
    return F.sha2(F.to_json(F.struct(*(fields[n].alias(n) for n in names)), {"ignoreNullFields": "false" if refresh else "true"}), 256)


def map_records(raw: DataFrame, corpus: Corpus, source: SourceSpec) -> DataFrame:
    """``seq, id, content_hash, provenance, fields, reason, detail``: reason is null for good rows,
    else mapping_error, missing_id or no_retrievable_text."""
    mapped: dict[str, tuple[Column, T.DataType]] = {}
    values: dict[str, Column] = {}
    errors: list[Column] = []
    work = raw
    for m in source.mapping:
        found = dotted(work.schema, m.source) or mapped.get(m.source)
        if found is None:
            continue
        col, kind = found
        out = transforms.apply(m.transform, col, kind, m.pattern)
        present = col.isNotNull()
        out = transforms.Mapped(out.value if m.transform == "list" else F.when(present, out.value), F.when(present, out.error), out.type)
        value, error = checked(corpus.fields[m.target], out)
        work = work.withColumn(f"_f_{m.target}", value).withColumn(f"_e_{m.target}", error)
        mapped[m.target] = (F.col(f"_f_{m.target}"), SPARK_TYPES[corpus.fields[m.target].type])
        errors.append(F.col(f"_e_{m.target}"))
    for name, spec in corpus.fields.items():
        if name in mapped:
            values[name] = F.col(f"_f_{name}")
        elif name in raw.columns:  # what the adapter already gives under the field's name
            value, error = checked(spec, transforms.Mapped(F.col(f"`{name}`"), F.lit(None).cast("string"), raw.schema[name].dataType))
            work = work.withColumn(f"_f_{name}", value).withColumn(f"_e_{name}", error)
            values[name], _ = F.col(f"_f_{name}"), errors.append(F.col(f"_e_{name}"))
        else:
            values[name] = F.lit(None).cast(SPARK_TYPES[spec.type])

    def from_raw(key: str) -> Column:
        found = dotted(raw.schema, source.provenance[key]) if key in source.provenance else None
        return F.lit(None).cast("string") if found is None else F.nullif(found[0].cast("string"), F.lit(""))

    provenance = F.struct(
        F.lit(source.provenance["source"]).alias("source"), F.coalesce(from_raw("media_ref"), F.lit("")).alias("media_ref"), from_raw("timestamp_field").alias("timestamp"),
        from_raw("extractor_field").alias("extractor"), from_raw("confidence_field").try_cast("double").alias("confidence"),
    )
    record_id = values[corpus.id_field].cast("string")
    searchable = [_has_text(corpus.fields[f].type, values[f]) for f in corpus.with_role("search")]
    texts = F.lit(False)
    for s in searchable:
        texts = texts | s
    first_error = F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string")
    no_id = record_id.isNull() | (F.trim(record_id) == "")
    reason = F.when(first_error.isNotNull(), "mapping_error").when(no_id, "missing_id").when(~texts & (provenance["media_ref"] == ""), "no_retrievable_text")
    return work.select(
        "seq", record_id.alias("id"), content_hash(values, corpus.refresh_hash_fields).alias("content_hash"), provenance.alias("provenance"),
        F.struct(*(c.alias(n) for n, c in values.items())).alias("fields"), reason.alias("reason"), F.coalesce(first_error, F.lit("")).alias("detail"),
    )


def check_dedupe(spec: Mapping) -> tuple[list[str], str, str | None]:
    keys, policy = spec.get("key"), spec.get("policy", "keep_first")
    if not isinstance(keys, list) or not keys or not all(isinstance(k, str) and k for k in keys):
        raise DedupeError("dedupe.key must be a list of field names that is not empty")
    if spec.get("order", "source_declaration") != "source_declaration":
        raise DedupeError("dedupe.order must be source_declaration")
    if policy not in POLICIES:
        raise DedupeError(f"unknown dedupe policy {policy!r}")
    return keys, policy, spec.get("namespace")


def dedupe(records: DataFrame, keys: list[Column], policy: str, seq: str = "seq", record_id: str = "id", timestamp: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """One winner for each key, in the place of the key's first arrival (``seq``); or, under
    ``version_append``, all rows with ``#v2``, ``#v3``, ... on later ids. Null keys are equal.

    ``newest`` compares timestamps as strings (null is ""), ``highest_confidence`` takes null
    as 0; ties keep the first.
    """
    if policy not in POLICIES:
        raise DedupeError(f"unknown dedupe policy {policy!r}")
    named = records.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    by = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))))
    drop = [f"_k{i}" for i in range(len(keys))]
    if policy == "version_append":
        n = F.row_number().over(by.orderBy(seq))
        return named.withColumn("_n", n).withColumn(record_id, F.when(F.col("_n") > 1, F.concat(F.col(record_id), F.lit("#v"), F.col("_n"))).otherwise(F.col(record_id))).drop("_n", *drop)
    order = {"keep_first": [], "newest": [F.coalesce(timestamp if timestamp is not None else F.lit(""), F.lit("")).desc()], "highest_confidence": [F.coalesce(confidence if confidence is not None else F.lit(0.0), F.lit(0.0)).desc()]}[policy]
    ranked = named.withColumn("_n", F.row_number().over(by.orderBy(*order, seq)))
    if policy != "keep_first":  # the winner takes the slot of the first arrival
        ranked = ranked.withColumn("_slot", F.min(seq).over(by))
    won = ranked.where("_n = 1")
    return (won if policy == "keep_first" else won.withColumn(seq, F.col("_slot")).drop("_slot")).drop("_n", *drop)


def namespaced(records: DataFrame, namespace: str | None) -> DataFrame:
    """Ids with the source's namespace before them; without one as they are."""
    return records.withColumn("id", F.concat(F.lit(f"{namespace}:"), "id")) if namespace else records


def split_known(records: DataFrame, manifest: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(added, skipped): rows whose id has the same content hash now are skipped.

    ``manifest`` (id, content_hash) has one row for each id. Rows are taken by ``order``: what an
    id has is the hash of its row before, in ``records`` or else in the manifest, so a content
    that comes back after another one is added again. A null hash is never the same.
    """
    was = manifest.select(F.col("id").alias("_id"), F.col("content_hash").alias("_held"))
    by = Window.partitionBy("id").orderBy(order)
    told = records.withColumn("_n", F.row_number().over(by)).withColumn("_before", F.lag("content_hash").over(by)).join(was, F.col("id") == F.col("_id"), "left")
    same = F.coalesce(F.when(F.col("_n") == 1, F.col("_held")).otherwise(F.col("_before")) == F.col("content_hash"), F.lit(False))
    told = told.withColumn("_same", same)
    return told.where("not _same").select(*records.columns), told.where("_same").select(*records.columns)


def current_hashes(manifest: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """The manifest after ``records``: id and content_hash, the last one of each id."""
    last = records.groupBy("id").agg(F.max_by("content_hash", order).alias("content_hash"))
    return manifest.select("id", "content_hash").join(last.select("id"), "id", "left_anti").unionByName(last)


def coverage(records: DataFrame, names: list[str], prefix: str = "fields.") -> DataFrame:
    """``field, present``: rows in which each field is not null, in one aggregation."""
    counted = records.agg(*(F.count(f"{prefix}{n}").alias(n) for n in names))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("present")) for n in names))).alias("x")).select("x.*")


def reconcile(reference: DataFrame, final: DataFrame, on: list[str]) -> DataFrame:
    """Rows in only one of both, with ``side`` missing (not in final) or extra; as multisets."""
    a, b = reference.select(*on), final.select(*on)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def reconciled(reference: DataFrame, final: DataFrame, key: str = "id") -> DataFrame:
    """``final``, if it has exactly the keys of ``reference``, each once; else an error.

    One aggregation over both key columns counts missing, extra and repeated keys and names the
    first of each."""
    both = reference.select(F.col(key).alias("k"), F.lit(1).alias("r"), F.lit(0).alias("f")).unionByName(final.select(F.col(key).alias("k"), F.lit(0).alias("r"), F.lit(1).alias("f")))
    counts = both.groupBy("k").agg(F.sum("r").alias("r"), F.sum("f").alias("f"))
    kind = F.when(F.col("f") == 0, "missing").when(F.col("r") == 0, "extra").when(F.col("f") > 1, "repeated")
    wrong = counts.select("k", kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("k").cast("string")).alias("first"))
    if rows := wrong.orderBy("kind").collect():  # at most three
        raise PipelineError("; ".join(f"{r['n']} {r['kind']}, first {r['first']!r}" for r in rows))
    return final


def in_reference_order(final: DataFrame, reference: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``final`` sorted as ``reference`` delivers its keys (first place of a key); others at the end by key."""
    place = reference.groupBy(key).agg(F.min(order).alias("_place"))
    return final.join(place, key, "left").orderBy(F.col("_place").asc_nulls_last(), key).drop("_place")


def carried_forward(skipped: DataFrame, previous: DataFrame, order: str = "seq") -> DataFrame:
    """Skipped rows with their previous payload, as stored; a missing one raises when it is read."""
    old = previous.select("id", F.struct(*[c for c in previous.columns if c != "id"]).alias("_old"))
    joined = skipped.select(order, "id").join(old, "id", "left")
    held = F.when(F.col("_old").isNotNull(), F.col("_old")).otherwise(F.raise_error(F.concat(F.lit("no previous payload for "), F.col("id"))))
    return joined.withColumn("_old", held).select(order, "id", "_old.*")


@dataclass
class IngestResult:
    source: str
    added: DataFrame
    skipped: DataFrame
    gaps: DataFrame
    coverage: DataFrame


@dataclass
class Pipeline:
    """Runs the sources of a corpus in declared order; a manifest (id, content_hash; one row for
    each id) of earlier runs makes it incremental, and each source sees the state that those
    before it left."""

    spark: SparkSession
    corpus: Corpus
    manifest: DataFrame | None = None
    adapters: Mapping[str, Callable] = field(default_factory=dict)

    def run(self, source: str | None = None) -> list[IngestResult]:
        specs = self.corpus.sources if source is None else [s for s in (self.corpus.source(source),) if s]
        if source is not None and not specs:
            raise PipelineError(f"unknown source {source!r}")
        return [self.run_source(s) for s in specs]

    def run_source(self, spec: SourceSpec) -> IngestResult:
        policy_of_failure = spec.missing.get("envelope_failure", "gap")
        if policy_of_failure not in ("gap", "abort"):
            raise PipelineError(f"source {spec.name}: envelope_failure is gap or abort")
        keys, policy, namespace = check_dedupe(spec.dedupe)
        mapped = staged(map_records(read_source(self.spark, spec, self.adapters), self.corpus, spec), f"mapped-{spec.name}")
        gaps = mapped.where("reason is not null").select(F.lit(spec.name).alias("source"), "seq", "reason", "detail")
        if policy_of_failure == "abort" and (bad := gaps.orderBy("seq").first()):
            raise PipelineError(f"source {spec.name}, row {bad['seq']}: {bad['reason']} {bad['detail']}")
        good = mapped.where("reason is null").drop("reason", "detail")
        good = namespaced(good, namespace)
        key_columns = [F.col("id") if k == self.corpus.id_field else F.col(f"fields.{k}") for k in keys]
        once = dedupe(good, key_columns, policy, timestamp=F.col("provenance.timestamp"), confidence=F.col("provenance.confidence"))
        if self.manifest is None:
            self.manifest = self.spark.createDataFrame([], "id string, content_hash string")
        added, skipped = split_known(once, self.manifest)
        added = staged(added, f"added-{spec.name}")
        self.manifest = staged(current_hashes(self.manifest, once), f"manifest-{spec.name}")
        return IngestResult(spec.name, added, skipped, gaps, coverage(good, list(self.corpus.fields)))


def added_records(results: list[IngestResult]) -> DataFrame:
    """All added records of several sources."""
    out = results[0].added
    for r in results[1:]:
        out = out.unionByName(r.added)
    return out
