"""Materialised aggregate views: declared groups, metrics and filters over records.

A view is one plan: filter, explode the list facets, group, and the seeded keys where a filter
lists values of a group key (every such key is seeded). With several keys the other keys of a
seeded row are null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import LIST_TYPES, NUMBER_TYPES, SPARK_TYPES, Corpus
from ..errors import FilterError, MaterializeError, StaleViewError, ViewConfigError
from ..session import discard

OPS = ("eq", "in", "gte", "lte", "between")
RANGES = ("gte", "lte", "between")
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
_STAMP = "materialized_at string, folder string"
PROVENANCE_ROW = "array<struct<record_id:string,source:string,media_ref:string,timestamp:string>>"


def parse_freshness(value: Any) -> timedelta:
    """``<n>s``, ``m``, ``h`` or ``d``."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(value))
    if not m or int(m[1]) <= 0:
        raise ViewConfigError(f"freshness must look like 24h, not {value!r}")
    return timedelta(**{_UNITS[m[2]]: int(m[1])})


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str  # count or mean
    field: str | None = None


@dataclass(frozen=True)
class View:
    name: str
    corpus: Corpus
    group_by: tuple[str, ...]
    metrics: tuple[Metric, ...]
    filters: dict[str, tuple[str, Any]]
    freshness: timedelta


def normal_filter(name: str, spec: Any) -> tuple[str, Any]:
    """A scalar means eq, a list means in; a mapping names the operation."""
    if isinstance(spec, dict):
        if set(spec) != {"op", "value"} or spec["op"] not in OPS:
            raise FilterError(f"filter {name}: needs op and value, op one of {', '.join(OPS)}")
        op, value = spec["op"], spec["value"]
    else:
        op, value = ("in" if isinstance(spec, list) else "eq"), spec
    if op == "in" and not isinstance(value, list):
        raise FilterError(f"filter {name}: in needs a list")
    if op == "between" and not (isinstance(value, list) and len(value) == 2):
        raise FilterError(f"filter {name}: between needs two values")
    return op, value


def parse_views(corpus: Corpus) -> list[View]:
    spec, out = corpus.materialize, []
    for raw in spec.get("views") or []:
        if not isinstance(raw, dict) or not raw.get("name"):
            raise ViewConfigError("a view needs a name")
        name = raw["name"]

        def need(ok: Any, message: str, name: str = name) -> None:
            if not ok:
                raise ViewConfigError(f"view {name}: {message}")

        keys = raw.get("group_by")
        need(isinstance(keys, list) and keys, "group_by must be a list that is not empty")
        for k in keys:
            need(k in corpus.fields and "facet" in corpus.fields[k].roles, f"group_by {k}: no facet")
        metrics = []
        need(isinstance(raw.get("metrics"), list) and raw["metrics"], "metrics must be a list that is not empty")
        for m in raw["metrics"]:
            need(isinstance(m, dict) and len(m) == 1, "a metric has one name and one formula")
            ((title, formula),) = m.items()
            if formula == "count":
                metrics.append(Metric(title, "count"))
                continue
            got = re.fullmatch(r"mean\((\w+)\)", str(formula))
            need(got and got[1] in corpus.fields and corpus.fields[got[1]].type in (*NUMBER_TYPES, "bool"), f"metric {title}: {formula!r} is neither count nor the mean of a number or bool")
            metrics.append(Metric(title, "mean", got[1]))
        filters = {}
        for field, f in (raw.get("filters") or {}).items():
            need(field in corpus.fields and set(corpus.fields[field].roles) & {"filter", "facet", "metric"}, f"filter {field}: not filterable")
            filters[field] = normal_filter(field, f)
            need(filters[field][0] not in RANGES or corpus.fields[field].type in NUMBER_TYPES, f"filter {field}: ranges need a number")
        freshness = raw.get("freshness", spec.get("freshness"))
        need(freshness is not None, "no freshness, neither its own nor the general one")
        out.append(View(name, corpus, tuple(keys), tuple(metrics), filters, parse_freshness(freshness)))
    return out


def view_condition(col: Column, is_list: bool, op: str, value: Any, numeric: bool = True) -> Column:
    """A view's filter: on lists eq is membership, in is overlap, a range holds for any item."""

    def one(x: Column) -> Column:
        if op == "eq":
            return x == F.lit(value)
        if op == "in":
            return x.isin(*value)
        low, high = (value, None) if op == "gte" else (None, value) if op == "lte" else value
        if not numeric:
            return F.lit(False)
        return (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)

    return F.coalesce(F.exists(col, one) if is_list else one(col), F.lit(False))


def _grouped(view: View, records: DataFrame, means: list[str], provenance: bool) -> tuple[DataFrame, Callable[[str], Column]]:
    """Filtered rows with the group keys (lists unfolded), the metrics' fields and the record pointer."""
    corpus = view.corpus
    nested = "fields" in records.columns and isinstance(records.schema["fields"].dataType, T.StructType)
    have = set(records.schema["fields"].dataType.names if nested else records.columns)
    field = lambda f: F.col(f"fields.{f}" if nested else f) if f in have else F.lit(None).cast(SPARK_TYPES[corpus.fields[f].type])
    rows = records
    for f, (op, value) in view.filters.items():
        rows = rows.where(view_condition(field(f), corpus.fields[f].type in LIST_TYPES, op, value, corpus.fields[f].type in NUMBER_TYPES))
    want = [field(f).alias(f"m_{f}") for f in means]
    if provenance:
        p = F.col("provenance") if "provenance" in records.columns else None
        part = [F.col("seq") if "seq" in records.columns else F.lit(0).alias("seq"), (F.col("id") if "id" in records.columns else field(corpus.id_field).cast("string")).alias("record_id")]
        part += [(p[n] if p is not None else F.lit(None).cast("string")).alias(n) for n in ("source", "media_ref", "timestamp")]
        want.append(F.struct(*part).alias("_p"))
    rows = rows.select(*(field(k).alias(k) for k in view.group_by), *want)
    for k in view.group_by:
        if corpus.fields[k].type in LIST_TYPES:  # several lists: every combination of their values
            rows = rows.withColumn(k, F.explode_outer(k))
    return rows, field


def materialize(view: View, records: DataFrame, now: datetime | None = None, provenance: bool = True) -> DataFrame:
    """Rows: group keys, metrics, provenance, materialized_at, schema_version.

    ``records`` has the struct ``fields`` (or the fields as columns), and for provenance id, the
    struct ``provenance`` and ``seq`` (the input order). Provenance holds a group's record
    pointers in one array, as a view row demands; for groups of unbounded size leave it out and use
    ``provenance_rows``.
    """
    if not isinstance(records, DataFrame):
        raise MaterializeError("records must be a DataFrame")
    corpus, now = view.corpus, now or datetime.now(UTC)
    means = {m.field for m in view.metrics if m.field}
    rows, field = _grouped(view, records, sorted(means), provenance)
    aggs = []
    for m in view.metrics:
        aggs.append(F.count(F.lit(1)).alias(m.name) if m.kind == "count" else F.avg(F.col(f"m_{m.field}").cast("double")).alias(m.name))
    if provenance:
        aggs.append(F.transform(F.array_sort(F.collect_list("_p")), lambda x: F.struct(x["record_id"].alias("record_id"), x["source"].alias("source"), x["media_ref"].alias("media_ref"), x["timestamp"].alias("timestamp"))).alias("provenance"))
    out = rows.groupBy(*view.group_by).agg(*aggs)
    for k in view.group_by:
        if k in view.filters and view.filters[k][0] == "in":
            out = _seeded(view, out, k)
    keys = [F.initcap(F.coalesce(F.col(k).cast("string"), F.lit("None"))) if corpus.fields[k].type == "bool" else F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in view.group_by]
    return out.withColumn("materialized_at", F.lit(now.astimezone(UTC).isoformat())).withColumn("schema_version", F.lit(corpus.schema_version)).orderBy(*keys)


def provenance_rows(view: View, records: DataFrame) -> DataFrame:
    """The records behind each group as rows (group keys, ``seq``, ``record_id``, ``source``, ``media_ref``,
    ``timestamp``): what the array of a view row holds, for groups of any size."""
    out = _grouped(view, records, [], True)[0]
    return out.select(*view.group_by, "_p.*")


def _seeded(view: View, rows: DataFrame, key: str) -> DataFrame:
    """The listed values of a filtered key that no record has, at count 0."""
    kind = rows.schema[key].dataType
    seeds = rows.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(view.filters[key][1])], T.StructType([T.StructField("_seed", kind)]))
    missing = seeds.join(rows.select(F.col(key).alias("_have")).distinct(), F.col("_seed") == F.col("_have"), "left_anti")
    cols = []
    for c in rows.columns:
        of = next((m for m in view.metrics if m.name == c), None)
        cols.append((F.col("_seed") if c == key else F.lit(0).cast("bigint") if of and of.kind == "count" else F.array() if c == "provenance" else F.lit(None)).cast(rows.schema[c].dataType).alias(c))
    return rows.unionByName(missing.select(*cols))


class ViewManager:
    """Stored views with their age: serving refuses what is missing or too old."""

    def __init__(self, spark: SparkSession, corpus: Corpus, path: str, clock: Callable[[], datetime] | None = None):
        self.spark, self.corpus, self.path = spark, corpus, path
        self.views = {v.name: v for v in parse_views(corpus)}
        self.clock = clock or (lambda: datetime.now(UTC))

    def _view(self, name: str) -> View:
        if name not in self.views:
            raise ViewConfigError(f"unknown view {name!r}")
        return self.views[name]

    def _state(self, name: str) -> tuple[datetime, str] | None:
        """When the view was last stored, and the folder of its rows."""
        try:
            row = self.spark.read.schema(_STAMP).json(f"{self.path}/_stamps/{name}").orderBy(F.col("materialized_at").desc()).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return (datetime.fromisoformat(row["materialized_at"]), row["folder"]) if row else None

    def _stamp(self, name: str) -> datetime | None:
        state = self._state(name)
        return state and state[0]

    def refresh(self, records: DataFrame, view: str | None = None, provenance: bool = True) -> list[str]:
        """Store the rows of one view or all. Rows go to a new folder; the stamp that names it is
        written last, by Spark, so readers see old rows with the old stamp or new ones with the new."""
        done = []
        for name in [view] if view else list(self.views):
            now, before = self.clock(), self._state(name)
            folder = f"{self.path}/{name}/{now.astimezone(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
            materialize(self._view(name), records, now, provenance).write.parquet(folder)
            self.spark.createDataFrame([(now.isoformat(), folder)], _STAMP).coalesce(1).write.mode("append").json(f"{self.path}/_stamps/{name}")
            if before:
                discard(self.spark, before[1])
            done.append(name)
        return done

    def serve(self, name: str) -> DataFrame:
        view, state = self._view(name), self._state(name)
        if state is None:
            raise StaleViewError(f"view {name} was never materialised")
        if self.clock() - state[0] > view.freshness:
            raise StaleViewError(f"view {name} is older than {view.freshness}")
        return self.spark.read.parquet(state[1])

    def status(self) -> dict[str, dict[str, Any]]:
        out = {}
        for name, view in self.views.items():
            stamp = self._stamp(name)
            age = None if stamp is None else self.clock() - stamp
            out[name] = {"materialized_at": stamp and stamp.isoformat(), "freshness": view.freshness.total_seconds(), "age": age and age.total_seconds(), "stale": age is None or age > view.freshness}
        return out
