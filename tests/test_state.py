"""State across deliveries, stored views, retrievers, the rebuilding gate and the port of older records."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.contract import parse_corpus
from lodestrata.errors import ConfigError, PipelineError
from lodestrata.operators import ingest, vector, views
from lodestrata.operators.lexical import LexicalIndex
from lodestrata.operators.rank import BestRows
from lodestrata.plans import gate, port, retrieve
from lodestrata.sources import adapters, sinks
from tests.test_ingest import FIELDS, corpus, tree  # noqa: F401
from tests.test_search import SPEC, asked, records  # noqa: F401
from tests.test_search import corpus as search_corpus  # noqa: F401


def told(added, skipped, key="seq"):
    return {**{r[key]: "added" for r in added.collect()}, **{r[key]: "skipped" for r in skipped.collect()}}


def test_a_content_that_comes_back_is_added(spark):
    shape = "seq bigint, id string, content_hash string"
    manifest = spark.createDataFrame([("x", "A"), ("n", None)], "id string, content_hash string")
    rows = spark.createDataFrame([(1, "x", "B"), (2, "x", "B"), (3, "x", "A"), (4, "y", "C"), (5, "y", "C"), (6, "n", None)], shape)
    assert told(*ingest.split_known(rows, manifest)) == {1: "added", 2: "skipped", 3: "added", 4: "added", 5: "skipped", 6: "added"}
    now = {r["id"]: r["content_hash"] for r in ingest.current_hashes(manifest, rows).collect()}
    assert now == {"x": "A", "y": "C", "n": None}
    empty = spark.createDataFrame([], shape)
    assert told(*ingest.split_known(empty, manifest)) == {}


def test_sources_see_the_state_that_those_before_left(spark, tmp_path):
    def source(name, text):
        (tmp_path / f"{name}.csv").write_text(f"id,caption\nx,{text}\n")
        return {"name": name, "adapter": "csv", "location": str(tmp_path / f"{name}.csv"), "mapping": {"post_id": {"from": "id"}, "caption": {"from": "caption"}}, "provenance": {"source": "s", "media_ref": "m", "timestamp_field": "t"}, "dedupe": {"key": ["post_id"]}}

    c = parse_corpus("x", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [source("one", "A"), source("two", "B"), source("three", "A"), source("four", "A")]})
    assert [r.added.count() for r in ingest.Pipeline(spark, c).run()] == [1, 1, 1, 0]


def test_an_empty_analysis_is_pending(spark, tree):  # noqa: F811
    (tree / "ds1/p2/analysis.json").write_text("{}")
    (tree / "ds1/p4/analysis.json").write_text(json.dumps({"analysis": {}, "schema_version": 2}))
    status = {r["id"]: r["fields"]["extraction_status"] for r in ingest.Pipeline(spark, corpus(tree)).run()[0].added.collect()}
    assert status == {"p1": "ok", "p2": "pending", "p4": "pending"}


@pytest.mark.parametrize("value", ["", "  ", None])
def test_provenance_must_not_be_empty(value):
    spec = {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [{"name": "s", "mapping": {}, "provenance": {"source": "x", "media_ref": value, "timestamp_field": "t"}}]}
    with pytest.raises(ConfigError):
        parse_corpus("x", spec)


def test_rows_are_numbered_in_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = [(r["seq"], r["k"]) for r in adapters.numbered(df, ["k"]).orderBy("seq").collect()]
    assert [s for s, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)
    assert adapters.numbered(df.limit(0), ["k"]).count() == 0


def test_reconciled(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert ingest.reconciled(ids("a", "b"), ids("b", "a")).count() == 2
    for final, say in ((ids("a"), "1 missing"), (ids("a", "b", "c"), "1 extra"), (ids("a", "b", "b"), "1 repeated")):
        with pytest.raises(PipelineError, match=say):
            ingest.reconciled(ids("a", "b"), final)


def test_older_records_are_ported_in_the_reference_order(spark, tree):  # noqa: F811
    shape = "seq bigint, post_id string, shortcode string, caption string, summary string, concepts array<struct<term:string,explanation:string>>, value_score bigint, provenance struct<media_ref:string,extracted_at:string,extractor_model:string,confidence:double>"
    rows = [(1, "p4", None, None, "from long ago", [("grid", "rows"), ("space", None)], 7, ("old/p4", "2025", "m", 0.5)), (2, "p9", "c9", "nine", None, None, None, None), (3, "p1", "c1", "other", None, None, 1, None)]
    old = spark.createDataFrame(rows, shape)
    c = corpus(tree)
    raw = port.legacy_raw(old)
    mapped = ingest.map_records(raw, c, c.sources[0]).where("reason is null").select("id", "content_hash", "provenance", "fields")
    ingested = ingest.Pipeline(spark, c).run()[0].added.where("id = 'p1'").select("id", "content_hash", "provenance", "fields")
    reference = old.select(F.col("post_id").alias("id"), "seq")
    final = port.ported(reference, ingested, mapped).collect()
    assert [r["id"] for r in final] == ["p4", "p9", "p1"]
    assert final[0]["fields"]["concepts"] == ["grid: rows", "space"] and final[0]["provenance"]["media_ref"] == "old/p4" and final[2]["fields"]["summary"] == "inner"
    with pytest.raises(PipelineError):
        port.ported(reference.union(spark.createDataFrame([("zz", 9)], "id string, seq bigint")), ingested, mapped)


def test_a_micro_batch_that_runs_again_gives_the_same(spark, tmp_path):
    from lodestrata.streaming.ingest import ingest_batch

    c = parse_corpus("x", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [{"name": "s", "mapping": {"post_id": {"from": "id"}, "caption": {"from": "caption"}}, "provenance": {"source": "x", "media_ref": "m", "timestamp_field": "t"}, "dedupe": {"key": ["post_id"]}}]})
    frame = lambda *rows: spark.createDataFrame(list(rows), "seq bigint, id string, caption string")
    out = f"file://{tmp_path}/out"
    for _ in range(2):
        ingest_batch(frame((1, "a", "one"), (2, None, "lost")), c, c.sources[0], out, 0)
    for _ in range(2):
        ingest_batch(frame((1, "a", "two"), (2, "b", "new")), c, c.sources[0], out, 1)
    ingest_batch(frame((1, "a", "one"), (2, "b", "new")), c, c.sources[0], out, 2)
    got = sorted((r["batch_id"], r["id"], r["fields"]["caption"]) for r in spark.read.parquet(f"{out}/records").collect())
    assert got == [(0, "a", "one"), (1, "a", "two"), (1, "b", "new"), (2, "a", "one")]
    assert spark.read.parquet(f"{out}/gaps").count() == 1


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    sinks.upsert(frame(*((f"k{i}", i) for i in range(50))), path, "k", buckets=8)
    files = {p for p in tmp_path.glob("t/*/*.parquet")}
    sinks.upsert(frame(("k7", 70)), path, "k", buckets=8)
    assert len(files & set(tmp_path.glob("t/*/*.parquet"))) >= 7
    got = {r["k"]: r["v"] for r in sinks.read_table(spark, path).collect()}
    assert got == {f"k{i}": (70 if i == 7 else i) for i in range(50)}
    assert sinks.read_table(spark, f"file://{tmp_path}/none") is None


def test_every_listed_key_is_seeded_and_provenance_comes_as_rows(spark, records):  # noqa: F811
    spec = json.loads(json.dumps(SPEC))
    spec["materialize"]["views"] = [{"name": "two", "group_by": ["owner", "tools"], "metrics": [{"n": "count"}], "filters": {"owner": ["ann", "ghost"], "tools": ["figma", "pen"]}}]
    view = views.parse_views(parse_corpus("c", spec))[0]
    got = {(r["owner"], r["tools"]): r["n"] for r in views.materialize(view, records).collect()}
    assert got == {("ann", "figma"): 2, ("ann", "sketch"): 1, ("ghost", None): 0, (None, "pen"): 0}
    rows = {(r["owner"], r["tools"], r["record_id"]) for r in views.provenance_rows(view, records).collect()}
    assert rows == {("ann", "figma", "r1"), ("ann", "sketch", "r1"), ("ann", "figma", "r2")}


def test_views_are_swapped_with_their_stamp(spark, search_corpus, records, tmp_path):  # noqa: F811
    clock = [datetime(2026, 1, 1, tzinfo=UTC)]
    m = views.ViewManager(spark, search_corpus, f"file://{tmp_path}/v", lambda: clock[0])
    m.refresh(records, "tools", provenance=False)
    old = m.serve("tools")
    first = old.count()
    clock[0] = datetime(2026, 1, 2, tzinfo=UTC)
    m.refresh(records.limit(0), "tools", provenance=False)
    assert first == 4 and m.serve("tools").count() == 0
    assert len([p for p in (tmp_path / "v/tools").iterdir() if p.is_dir()]) == 1


def words(spark, *rows):
    p = F.struct(F.lit("s").alias("source"), F.lit("m").alias("media_ref"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("extractor"), F.lit(None).cast("double").alias("confidence"))
    df = spark.createDataFrame([(i, i, None, None, None, None, t) for i, t in rows], "id string, rec_id string, owner string, tools array<string>, score bigint, good boolean, summary string")
    return df.select("id", p.alias("provenance"), F.struct("rec_id", "owner", "tools", "score", "good", "summary").alias("fields"))


def test_one_vector_for_each_record(spark, search_corpus):  # noqa: F811
    records = words(spark, ("p0", "unrelated"), ("p1", "palette color systems"), ("p2", None))
    index = retrieve.VectorIndex.of_documents(records, search_corpus, vector.hash_embedder(64))
    hits = index.search(asked(spark, "palette color systems"), 3).orderBy("rank").collect()
    assert [(r["record_id"], r["score"]) for r in hits] == [("p1", 1.0), ("p0", 0.0), ("p2", 0.0)]
    assert hits[0]["chunk_id"] == "p1::__document__::0"
    near = index.search(asked(spark, "palette color systems"), 1, score="distance").first()
    assert near["record_id"] == "p1" and near["score"] == pytest.approx(1.0, abs=1e-6)
    late = index.search(asked(spark, "palette color systems"), 1, F.col("owner").isNull(), prefilter=False)
    assert [r["record_id"] for r in late.collect()] == ["p1"]


def test_records_of_many_questions(spark):
    rows = [("r0", f"c{i:02}", "color " * (40 - i)) for i in range(30)] + [(f"r{i}", f"d{i}", "color grid poster sheet paper") for i in range(1, 5)]
    chunks = spark.createDataFrame(rows, "record_id string, chunk_id string, text string")
    ranked = retrieve.lexical_ranked(LexicalIndex.build(chunks, keep=True), asked(spark, "color", "nothing here"), 3)
    got = [(r["qid"], r["record_id"], r["rank"]) for r in ranked.orderBy("qid", "rank").collect()]
    assert [r for _, r, _ in got] == ["r0", "r1", "r2"] and [n for *_, n in got] == [1, 2, 3]
    assert retrieve.hybrid_ranked(ranked, None, 3) is ranked
    both = retrieve.hybrid_ranked(ranked, ranked.where("record_id <> 'r0'").withColumn("rank", F.col("rank") - 1), 3)
    assert {r["record_id"] for r in both.collect()} == {"r0", "r1", "r2"}


def test_best_rows_over_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    score, first = np.round(rng.random((5, 400)), 1), rng.random((5, 400)) < 0.02
    keys = np.array([f"k{i:03}" for i in rng.permutation(400)])
    best = BestRows(5, 7)
    for at in range(0, 400, 90):
        best.add(score[:, at : at + 90], keys[at : at + 90], None, first[:, at : at + 90])
    q, key, s, f = best.rows()
    for i in range(5):
        want = sorted((not first[i, j], -score[i, j], keys[j]) for j in range(400))[:7]
        assert [(not a, -b, c) for a, b, c in zip(f[q == i], s[q == i], key[q == i])] == want


def test_vector_queries_of_odd_lengths(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), ("n", [float("nan"), 1.0])], "k string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 1.0, 1.0]), ("z", None)], "qid string, query array<double>")
    got = {(r["qid"], r["k"]): r["score"] for r in vector.vector_search_many(v, q, 5, key="k").collect()}
    assert got == {("x", "a"): 1.0, ("x", "b"): 0.0, ("y", "d"): 1.0}
    assert vector.vector_search_many(v.limit(0), q, 5, key="k").count() == 0 and vector.vector_search_many(v, q.limit(0), 5, key="k").count() == 0


def test_the_gate_rebuilds_and_retrieves(spark, search_corpus, tmp_path):  # noqa: F811
    records = words(spark, ("p0", "grids for posters"), ("p1", "palette color systems"), ("p2", "animation of buttons"))
    questions = spark.createDataFrame([("q1", "palette color", "search", "easy", ["p1"]), ("q2", "buttons animation", "search", None, ["p2"]), ("q3", "quantum", "abstain", None, [])], "question_id string, question string, mode string, difficulty string, expected array<string>")
    versions = gate.Versions("7", "0", "v1", {"model": "none"})
    path = gate.write_baseline(gate.Baseline(versions, "c", {m: 1.0 for m in gate.METRICS}, "2026-01-01"), tmp_path / "b.json")
    for mode in ("bm25", "dense", "document", "hybrid"):
        code, report = gate.rebuilt_gate(search_corpus, records, questions, versions, path, tmp_path / "out", mode, vector.hash_embedder(64))
        assert report["metrics"]["recall@5"] == 1.0 and code == (0 if report["metrics"]["mrr"] >= 0.98 else 1)
    raw = json.loads(path.read_text())
    (tmp_path / "numbers.json").write_text(json.dumps(raw | {"schema_version": 7, "index_version": 0}))
    assert gate.run_gate(versions, {m: 1.0 for m in gate.METRICS}, gate.load_baseline(tmp_path / "numbers.json")).decision == "pass"
    (tmp_path / "undated.json").write_text(json.dumps({k: v for k, v in raw.items() if k != "generated_at"}))
    with pytest.raises(ValueError, match="generated_at"):
        gate.load_baseline(tmp_path / "undated.json")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lodestrata import session

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_providers_fail_closed(spark, monkeypatch):
    from lodestrata.errors import EmbeddingError

    texts = spark.createDataFrame([("a",)], "text string")
    for provider, (package, key, _) in vector.PROVIDERS.items():
        monkeypatch.delenv(key, raising=False)
        e = vector.named_embedder(provider, "some-model", 8)
        with pytest.raises(EmbeddingError, match=key):
            e.embed(texts)
        monkeypatch.setenv(key, "x")
        with pytest.raises(EmbeddingError, match=package):
            e.embed(texts)
    with pytest.raises(EmbeddingError):
        vector.named_embedder("nobody", "m", 8)


def test_search_in_place_equals_the_joined_plan(spark, monkeypatch):
    import random

    from lodestrata.operators import lexical

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03}", f"r{i // 3}", rng.choice("ab"), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) if i % 17 else None) for i in range(150)]
    index = LexicalIndex.build(spark.createDataFrame(rows, "chunk_id string, record_id string, kind string, text string"), keep=True)
    q = asked(spark, "w1 w2", "w3-w4 w5", "w6 w6 w7", "missing w8", "w9", "— w10", "", "w1 w2 w3 w4")
    ways = [dict(), dict(keep_if=F.col("kind") == "a"), dict(keep_if=F.col("kind") == "a", prefilter=True)]
    here = [sorted(map(tuple, index.search(q, 4, **w).collect())) for w in ways]
    monkeypatch.setattr(lexical, "MAX_SENT_TOKENS", 0)
    there = [sorted(map(tuple, index.search(q, 4, **w).collect())) for w in ways]
    assert here == there and all(here)
