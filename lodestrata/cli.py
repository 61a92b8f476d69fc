"""``python -m lodestrata.cli``: search, get, schema and the quality gate over Parquet tables, as JSON.

Exit code 0 with a result, 2 with ``{"error": ...}`` for a typed error; the gate's own codes with
``--gate``.
"""

from __future__ import annotations

import argparse
import functools
import json
import sys
from pathlib import Path

from .contract import load
from .errors import EngineError, QueryParamsError
from .operators.lexical import LexicalIndex
from .operators.vector import hash_embedder
from .plans.gate import Versions, rebuilt_gate
from .plans.params import QueryParams, parse_filters, parse_sort
from .plans.retrieve import VectorIndex
from .plans.serve import describe, get, hybrid, per_record, serve
from .session import local_session
from .sources.adapters import gold_questions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--search")
    what.add_argument("--get")
    what.add_argument("--schema", action="store_true")
    what.add_argument("--gate", action="store_true")
    for name in ("--config", "--corpus", "--records", "--chunks", "--params", "--params-file", "--mode", "--gold", "--baseline", "--out"):
        p.add_argument(name, default="config.yaml" if name == "--config" else None)
    return p


def searches(chunks, dims: int = 64) -> dict:
    """Retrieval by mode over a chunk table; the vectors are made once, when a dense mode is first asked."""
    spark = chunks.sparkSession
    index = LexicalIndex.build(chunks, keep=True)
    asked = lambda query: spark.createDataFrame([("q", query)], "qid string, question string")
    vectors = functools.cache(lambda: VectorIndex.of_chunks(chunks.select("chunk_id", "record_id", "text"), hash_embedder(dims)))

    def lexical(query: str, k: int):
        return index.search(asked(query), k).select("record_id", "chunk_id", "score", "rank")

    def dense(query: str, k: int):
        return vectors().search(asked(query), k).select("record_id", "chunk_id", "score", "rank")

    one, two = per_record(lexical), per_record(dense)
    return {"bm25": one, "dense": two, "hybrid": hybrid(one, two)}


def run_gate(args: argparse.Namespace, corpus, spark, records) -> tuple[int, dict]:
    """Rebuild, retrieve, evaluate and compare; the exit code of the gate and its report."""
    if not (args.gold and args.baseline and records is not None):
        raise QueryParamsError("the gate needs --records, --gold and --baseline")
    embedder = hash_embedder()
    versions = Versions(corpus.schema_version, str(corpus.index.get("schema_version", "1")), str(corpus.verify.get("eval_set_version", "v1")), corpus.verify.get("embedder_version") or {"provider": "hash", "model": embedder.model, "dims": embedder.dims})
    return rebuilt_gate(corpus, records, gold_questions(spark, args.gold), versions, args.baseline, args.out or "artifacts/verify", args.mode or "bm25", embedder)


def run(args: argparse.Namespace) -> tuple[int, dict]:
    corpus = load(args.config).corpus(args.corpus)
    if args.schema:
        return 0, describe(corpus)
    raw = json.loads(args.params) if args.params else json.loads(Path(args.params_file).read_text()) if args.params_file else {}
    if not isinstance(raw, dict):
        raise QueryParamsError("params must be a JSON object")
    params = QueryParams(args.search or raw.get("query", ""), args.mode or raw.get("mode"), raw.get("top_k"), corpus.name, raw.get("cursor"), parse_filters(corpus, raw.get("filters")), parse_sort(corpus, raw.get("sort")))
    spark = local_session()
    records = spark.read.parquet(args.records) if args.records else None
    if args.gate:
        return run_gate(args, corpus, spark, records)
    if args.get:
        return 0, {"record": get(args.get, records) if records is not None else None}
    return 0, serve(corpus, searches(spark.read.parquet(args.chunks)), params, records).to_dict()


def main(argv: list[str] | None = None) -> int:
    try:
        code, out = run(parser().parse_args(argv))
        print(json.dumps(out, default=str, ensure_ascii=False))
    except (EngineError, json.JSONDecodeError) as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}))
        return 2
    return code


if __name__ == "__main__":
    sys.exit(main())
