"""Sinks: upserting index tables in key buckets, vectors of fixed length, clearing, and JSON that is only
written when it changes."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


BUCKETS = 64
_BUCKET = "_bucket"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an upserted table; None if it was never written."""
    old = _stored(spark, path)
    return old.drop(_BUCKET) if old is not None else None


def upsert(df: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Write rows by key: new rows replace stored ones, of equal keys in ``df`` the last by
    ``order`` stays.

    The table is partitioned by a hash of the key. Only partitions that the new rows touch are read
    and replaced; their new content is staged before, and a partition is swapped as one folder when
    the job commits, so a failure on the way leaves the stored rows.
    """
    spark = df.sparkSession
    if order:
        w = Window.partitionBy(key).orderBy(F.col(order).desc())
        new = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    else:
        new = df.dropDuplicates([key])
    new = staged(new.withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")), "upsert-new")
    old = _stored(spark, path)
    whole = new
    if old is not None:
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        cols = [c for c in old.columns if c != _BUCKET]
        kept = old.where(F.col(_BUCKET).isin(touched)).join(new.select(key), key, "left_anti")
        whole = staged(kept.select(*cols, _BUCKET).unionByName(new.select(*cols, _BUCKET)), "upsert")
    whole.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def write_vectors(df: DataFrame, path: str, dims: int, key: str = "chunk_id", vector: str = "embedding") -> None:
    """Upsert vectors as ``array<float>``; another length than ``dims`` is an error."""
    checked = df.withColumn(vector, F.when(F.size(vector) == dims, F.col(vector).cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {dims} dimensions: "), F.col(key)))))
    upsert(checked, path, key)


def clear(spark: SparkSession, path: str) -> None:
    """Drop all rows and keep the columns."""
    old = read_table(spark, path)
    if old is not None:
        spark.createDataFrame([], old.schema.add(_BUCKET, "integer")).write.mode("overwrite").parquet(path)


def write_json(path: str | Path, value: Any) -> bool:
    """Sorted keys, stable bytes; false if the file held them already."""
    path = Path(path)
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    if path.exists() and path.read_text(encoding="utf-8") == text:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return True
