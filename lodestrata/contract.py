"""Data contracts: one YAML file for each corpus, checked when loaded, compiled to Spark types.

A broken corpus is kept as an error and never hides the others. Field names are known to the
contract only; the engine's operators get them from here.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from .errors import ConfigError

#: The declared types and the Spark types that hold them.
SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "string": T.StringType(),
    "url": T.StringType(),
    "datetime": T.StringType(),
    "date": T.StringType(),
    "list[text]": T.ArrayType(T.StringType()),
    "list[string]": T.ArrayType(T.StringType()),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "object": T.StringType(),
    "list[object]": T.ArrayType(T.StringType()),
}
ROLES = ("search", "filter", "facet", "metric", "sort", "passthrough")
LIST_TYPES = ("list[text]", "list[string]")
NUMBER_TYPES = ("int", "float")
OBJECT_TYPES = ("object", "list[object]")
ADAPTERS = ("ig_saved", "csv")
TRANSFORMS = ("identity", "coerce_str", "coerce_int", "coerce_bool", "coerce_float", "list", "template", "path_join")

_VARIABLE = re.compile(r"\$\{(\w+)\}")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    roles: tuple[str, ...] = ()
    weight: float | None = None

    @property
    def is_list(self) -> bool:
        return self.type in LIST_TYPES


@dataclass(frozen=True)
class MappingSpec:
    target: str
    source: str
    transform: str = "identity"
    pattern: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    name: str
    adapter: str | None
    location: str | None
    snapshot: str | None
    mapping: tuple[MappingSpec, ...]
    provenance: dict[str, str]
    dedupe: dict[str, Any]
    missing: dict[str, Any]


@dataclass(frozen=True)
class Corpus:
    name: str
    path: str
    schema_version: str
    id_field: str
    fields: dict[str, FieldSpec]
    refresh_hash_fields: tuple[str, ...] = ()
    sources: tuple[SourceSpec, ...] = ()
    index: dict[str, Any] = field(default_factory=dict)
    materialize: dict[str, Any] = field(default_factory=dict)
    verify: dict[str, Any] = field(default_factory=dict)
    serve: dict[str, Any] = field(default_factory=dict)

    def with_role(self, *roles: str) -> list[str]:
        """Names of the fields that have one of the roles, in declared order."""
        return [f.name for f in self.fields.values() if set(f.roles) & set(roles)]

    def source(self, name: str) -> SourceSpec | None:
        return next((s for s in self.sources if s.name == name), None)

    def struct(self) -> T.StructType:
        """The Spark schema of a record's fields; roles and weight are column metadata."""
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type], True, {"type": f.type, "roles": list(f.roles), **({"weight": f.weight} if f.weight is not None else {})}) for f in self.fields.values()])


@dataclass
class Config:
    path: str
    artifacts_dir: Path
    user_data_dir: Path
    corpora_dir: Path
    default_corpus: str | None
    embedding: dict[str, Any]
    verify: dict[str, Any]
    corpora: dict[str, Corpus] = field(default_factory=dict)
    errors: dict[str, ConfigError] = field(default_factory=dict)

    def corpus(self, name: str | None = None) -> Corpus:
        """A corpus by name (or the default one); raises what was wrong with a broken one."""
        name = name or self.default_corpus
        if name in self.errors:
            raise self.errors[name]
        if name not in self.corpora:
            raise ConfigError(f"unknown corpus {name!r}", str(name), self.path)
        return self.corpora[name]


def expand(value: str) -> str:
    """``${NAME}`` from the environment; names that are not set stay as written."""
    return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), value)


def resolved(value: Any, base: Path) -> Path:
    path = Path(expand(str(value)))
    return path if path.is_absolute() else base / path


def _iso(value: Any) -> bool:
    try:
        datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


class _Checker:
    """Checks one corpus file; every complaint names the corpus and the file."""

    def __init__(self, name: str, path: Path):
        self.name, self.path = name, path

    def fail(self, message: str) -> None:
        raise ConfigError(message, self.name, str(self.path))

    def need(self, ok: Any, message: str) -> None:
        if not ok:
            self.fail(message)

    def mapping(self, value: Any, what: str) -> dict:
        value = {} if value is None else value
        self.need(isinstance(value, dict), f"{what} must be a mapping")
        return value

    def field(self, name: str, spec: Any) -> FieldSpec:
        spec = self.mapping(spec, f"field {name}")
        kind = spec.get("type")
        self.need(kind in SPARK_TYPES, f"field {name}: unknown type {kind!r}")
        role = spec.get("role")
        roles = [] if role is None else [role] if isinstance(role, str) else role
        self.need(isinstance(roles, list), f"field {name}: role must be a string or a list")
        roles = tuple(dict.fromkeys(roles))
        for r in roles:
            self.need(r in ROLES, f"field {name}: unknown role {r!r}")
        if kind in OBJECT_TYPES:
            self.need(roles == ("passthrough",), f"field {name}: an object has the role passthrough and no other")
        else:
            self.need("passthrough" not in roles, f"field {name}: passthrough is for objects")
        self.need("metric" not in roles or kind in NUMBER_TYPES, f"field {name}: a metric is an int or a float")
        weight = spec.get("weight")
        if weight is not None:
            self.need("search" in roles, f"field {name}: only search fields have a weight")
            self.need(isinstance(weight, (int, float)) and not isinstance(weight, bool) and weight > 0, f"field {name}: weight must be a positive number")
        if kind in ("datetime", "date") and spec.get("example") is not None:
            self.need(_iso(spec["example"]), f"field {name}: the example is no ISO date")
        return FieldSpec(name, kind, roles, None if weight is None else float(weight))

    def source(self, raw: Any, at: int, fields: dict[str, FieldSpec]) -> SourceSpec:
        self.need(isinstance(raw, dict), f"source {at} must be a mapping")
        name = raw.get("name")
        self.need(isinstance(name, str) and name, f"source {at} has no name")
        adapter = raw.get("adapter")
        self.need(adapter is None or adapter in ADAPTERS, f"source {name}: adapter {adapter!r} is not registered")
        mapped = []
        for target, m in self.mapping(raw.get("mapping"), f"source {name}: mapping").items():
            self.need(target in fields, f"source {name}: {target} is no declared field")
            m = self.mapping(m, f"source {name}: {target}")
            self.need(isinstance(m.get("from"), str) and m["from"], f"source {name}: {target} has no from")
            transform = m.get("transform", "identity")
            self.need(transform in TRANSFORMS, f"source {name}: transform {transform!r} is not registered")
            mapped.append(MappingSpec(target, m["from"], transform, m.get("pattern")))
        provenance = self.mapping(raw.get("provenance"), f"source {name}: provenance")
        for key in ("source", "media_ref", "timestamp_field"):
            self.need(provenance.get(key) is not None and str(provenance[key]).strip(), f"source {name}: provenance has no {key}")
        location = raw.get("location")
        if location is not None:
            location = str(resolved(location, self.path.parent.parent))
        return SourceSpec(name, adapter, location, raw.get("snapshot"), tuple(mapped), {k: str(v) for k, v in provenance.items()}, self.mapping(raw.get("dedupe"), "dedupe"), self.mapping(raw.get("missing"), "missing"))

    def corpus(self, raw: Any) -> Corpus:
        self.need(isinstance(raw, dict), "the contract must be a mapping")
        schema = self.mapping(raw.get("schema"), "schema")
        version = schema.get("schema_version")
        self.need(isinstance(version, str) and version.strip(), "schema.schema_version must be a string that is not empty")
        declared = self.mapping(schema.get("fields"), "schema.fields")
        self.need(declared, "schema.fields is empty")
        fields = {str(n): self.field(str(n), s) for n, s in declared.items()}
        id_field = schema.get("id_field")
        self.need(id_field in fields, f"schema.id_field {id_field!r} is no declared field")
        refresh = schema.get("refresh_hash_fields") or []
        self.need(isinstance(refresh, list), "schema.refresh_hash_fields must be a list")
        for r in refresh:
            self.need(r in fields, f"schema.refresh_hash_fields: {r} is no declared field")
        sources = raw.get("sources") or []
        self.need(isinstance(sources, list), "sources must be a list")
        return Corpus(self.name, str(self.path), version, id_field, fields, tuple(refresh), tuple(self.source(s, i, fields) for i, s in enumerate(sources)), *(self.mapping(raw.get(k), k) for k in ("index", "materialize", "verify", "serve")))


def read_yaml(path: Path) -> Any:
    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"cannot be read: {e}", path.stem, str(path)) from e


def parse_corpus(name: str, raw: Any, path: str | Path = "") -> Corpus:
    return _Checker(name, Path(path)).corpus(raw)


def load(path: str | Path = "config.yaml") -> Config:
    """The engine file and all corpora beside it, in order of their names."""
    path = Path(path)
    raw = read_yaml(path) or {}
    if not isinstance(raw, dict):
        raise ConfigError("the engine file must be a mapping", "", str(path))
    engine = raw.get("engine") or {}
    base = path.resolve().parent
    config = Config(str(path), *(resolved(engine.get(k, d), base) for k, d in (("artifacts_dir", "artifacts"), ("user_data_dir", "user_data"), ("corpora_dir", "corpora"))), engine.get("default_corpus"), raw.get("embedding") or {}, raw.get("verify") or {})
    for file in sorted(config.corpora_dir.glob("*.yaml")):
        try:
            config.corpora[file.stem] = parse_corpus(file.stem, read_yaml(file), file)
        except ConfigError as e:
            config.errors[file.stem] = e
    return config
