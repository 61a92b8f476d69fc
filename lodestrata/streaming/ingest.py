"""Incremental ingest as a stream: each micro-batch passes the same plan as a batch run.

``ingest_stream`` reads a streaming frame of raw rows, maps them by the contract, dedupes them
(within the micro-batch, as a run does within its sources), skips what has not changed since
the batches before, and writes records and gaps of a micro-batch to folders of its own. A
micro-batch that runs again after a failure replaces those folders, so nothing is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contract import Corpus, SourceSpec
from ..operators import ingest
from ..session import staged


def _manifest(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The last content hash of each id in the micro-batches before one."""
    from ..sources.sinks import _stored

    old = _stored(spark, path)
    if old is None:
        return spark.createDataFrame([], "id string, content_hash string")
    return old.where(F.col("batch_id") < before).groupBy("id").agg(F.max_by("content_hash", F.struct("batch_id", "seq")).alias("content_hash"))


def ingest_batch(batch: DataFrame, corpus: Corpus, source: SourceSpec, out: str, batch_id: int) -> None:
    """Write the new records and the gaps of one micro-batch; running it again gives the same."""
    keys, policy, namespace = ingest.check_dedupe(source.dedupe)
    mapped = staged(ingest.map_records(batch, corpus, source), f"stream-{batch_id}")
    good = ingest.namespaced(mapped.where("reason is null").drop("reason", "detail"), namespace)
    columns: list[Column] = [F.col("id") if k == corpus.id_field else F.col(f"fields.{k}") for k in keys]
    once = ingest.dedupe(good, columns, policy, timestamp=F.col("provenance.timestamp"), confidence=F.col("provenance.confidence"))
    added, _ = ingest.split_known(once, _manifest(batch.sparkSession, f"{out}/records", batch_id))
    added.write.mode("overwrite").parquet(f"{out}/records/batch_id={batch_id}")
    gaps = mapped.where("reason is not null").select("seq", "reason", "detail")
    gaps.write.mode("overwrite").parquet(f"{out}/gaps/batch_id={batch_id}")


def ingest_stream(raw: DataFrame, corpus: Corpus, source: SourceSpec, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream; ``raw`` has ``seq`` and the columns that the mapping names."""
    writer = raw.writeStream.foreachBatch(lambda df, n: ingest_batch(df, corpus, source, out, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
