import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.contract import parse_corpus
from lodestrata.errors import AdapterError, DedupeError, PipelineError
from lodestrata.functions import transforms
from lodestrata.operators import ingest
from lodestrata.sources import adapters, sinks

FIELDS = {"post_id": {"type": "string"}, "shortcode": {"type": "string"}, "url": {"type": "url"}, "owner": {"type": "string", "role": ["filter"]}, "caption": {"type": "text", "role": ["search"]}, "summary": {"type": "text", "role": ["search"]}, "concepts": {"type": "list[string]", "role": ["search"]}, "value_score": {"type": "int", "role": ["metric"]}, "extraction_status": {"type": "string"}}


def corpus(location, **dedupe):
    mapping = {
        "post_id": {"from": "metadata.id", "transform": "coerce_str"}, "shortcode": {"from": "metadata.shortCode"}, "url": {"from": "shortcode", "transform": "template", "pattern": "https://p/{value}/"},
        "owner": {"from": "metadata.ownerUsername"}, "caption": {"from": "metadata.caption"}, "summary": {"from": "analysis.summary"}, "concepts": {"from": "analysis.concepts", "transform": "list"}, "value_score": {"from": "analysis.value_score", "transform": "coerce_int"},
    }
    source = {"name": "tree", "adapter": "ig_saved", "location": str(location), "snapshot": "snap", "mapping": mapping, "provenance": {"source": "saved", "media_ref": "dataset_post_dir", "timestamp_field": "analysis.analysed_at", "confidence_field": "analysis.confidence"}, "dedupe": {"key": ["post_id"]} | dedupe.pop("dedupe", {}), "missing": dedupe}
    return parse_corpus("posts", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [source]})


@pytest.fixture
def tree(tmp_path):
    def post(name, meta, analysis=None, media=()):
        d = tmp_path / "ds1" / name
        d.mkdir(parents=True)
        (d / "post_metadata.json").write_text(json.dumps(meta))
        if analysis:
            (d / "analysis.json").write_text(json.dumps(analysis))
        for m in media:
            (d / m).write_bytes(b"x")

    post("p1", {"id": "p1", "shortCode": "c1", "ownerUsername": "ann", "caption": "design"}, {"summary": "outer", "value_score": 8, "analysis": {"summary": "inner", "concepts": [{"term": "grid", "explanation": "rows"}, "space"]}, "confidence": 0.5}, ["b.jpg", "a.jpg"])
    post("p2", {"id": "p2", "shortCode": "c2", "caption": "only a caption"})
    post("p3", {"shortCode": "c3", "caption": "no id"})
    post("p4", {"id": "p4", "caption": " "}, media=["x.mp4"])
    post("p5", {"id": "p5", "caption": " "})
    (tmp_path / "ds1" / "p6").mkdir()
    (tmp_path / "ds1" / "p6" / "note.txt").write_text("no metadata")
    return tmp_path


def test_tree_is_mapped_and_gaps_are_kept(spark, tree):
    (r,) = ingest.Pipeline(spark, corpus(tree)).run()
    rows = {x["id"]: x for x in r.added.collect()}
    assert set(rows) == {"p1", "p2", "p4"}
    f = rows["p1"]["fields"]
    assert (f["summary"], f["concepts"], f["value_score"], f["url"], f["extraction_status"]) == ("inner", ["grid: rows", "space"], 8, "https://p/c1/", "ok")
    assert rows["p1"]["provenance"]["media_ref"] == "snap/ds1/p1" and rows["p2"]["provenance"]["media_ref"] == ""
    assert rows["p2"]["fields"]["extraction_status"] == "pending"
    assert {x["reason"] for x in r.gaps.collect()} == {"missing_id", "no_retrievable_text"}
    assert {x["field"]: x["present"] for x in r.coverage.collect()}["caption"] == 3


def test_second_run_skips_and_namespace_prefixes(spark, tree):
    p = ingest.Pipeline(spark, corpus(tree, dedupe={"namespace": "b"}))
    assert {x["id"] for x in p.run()[0].added.collect()} == {"b:p1", "b:p2", "b:p4"}
    again = p.run()[0]
    assert again.added.isEmpty() and again.skipped.count() == 3


def test_abort_and_unknown_sources(spark, tree):
    with pytest.raises(PipelineError):
        ingest.Pipeline(spark, corpus(tree, envelope_failure="abort")).run()
    with pytest.raises(PipelineError):
        ingest.Pipeline(spark, corpus(tree)).run("nope")
    with pytest.raises(AdapterError):
        ingest.Pipeline(spark, corpus(tree / "missing")).run()


def test_malformed_json_ends_the_load(spark, tree):
    (tree / "ds1/p1/post_metadata.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.Pipeline(spark, corpus(tree)).run()


def test_dedupe_policies(spark):
    rows = spark.createDataFrame([(1, "dup", "2026-01-01", 0.2), (2, "solo", None, None), (3, "dup", "2026-03-01", 0.1), (4, "dup", None, 0.9)], "seq bigint, id string, ts string, c double")

    def run(policy):
        out = ingest.dedupe(rows, [F.col("id")], policy, timestamp=F.col("ts"), confidence=F.col("c"))
        return [(r["seq"], r["id"], r["ts"]) for r in out.orderBy("seq").collect()]

    assert run("keep_first") == [(1, "dup", "2026-01-01"), (2, "solo", None)]
    assert run("newest") == [(1, "dup", "2026-03-01"), (2, "solo", None)]
    assert run("highest_confidence") == [(1, "dup", None), (2, "solo", None)]
    assert [i for _, i, _ in run("version_append")] == ["dup", "solo", "dup#v2", "dup#v3"]
    for bad in ({"key": []}, {"key": ["a"], "order": "random"}, {"key": ["a"], "policy": "best"}):
        with pytest.raises(DedupeError):
            ingest.check_dedupe(bad)


def one(spark, mapped):
    r = spark.range(1).select(mapped.value.alias("v"), mapped.error.alias("e")).first()
    return r["v"], r["e"]


def test_transforms(spark):
    s, i, d, b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
    cases = [
        ("coerce_str", F.lit(42), i, "42"), ("coerce_str", F.lit(True), b, "true"), ("coerce_int", F.lit(" 12 "), s, 12), ("coerce_int", F.lit(3.0), d, 3), ("coerce_bool", F.lit("No"), s, False),
        ("coerce_bool", F.lit(1), i, True), ("coerce_float", F.lit("1.5"), s, 1.5), ("list", F.lit("solo"), s, ["solo"]), ("list", F.lit(None).cast("string"), s, []), ("path_join", F.array(F.lit("a"), F.lit(""), F.lit(None), F.lit("d")), T.ArrayType(s), "a/d"),
    ]
    for name, value, kind, want in cases:
        assert one(spark, transforms.apply(name, value, kind)) == (want, None), name
    for name, value, kind in [("coerce_int", F.lit("12.7"), s), ("coerce_int", F.lit(1.5), d), ("coerce_int", F.lit(True), b), ("coerce_bool", F.lit("maybe"), s), ("coerce_bool", F.lit(2), i), ("coerce_float", F.lit("x"), s)]:
        value, error = one(spark, transforms.apply(name, value, kind))
        assert value is None and error
    with pytest.raises(transforms.TransformError):
        transforms.apply("template", F.lit("x"), s)
    with pytest.raises(transforms.TransformError):
        transforms.apply("magic", F.lit("x"), s)


def test_flatten_structs(spark):
    df = spark.createDataFrame([([("a", "why"), ("b", None)], [("x", "use"), (None, None)])], "c array<struct<term:string,explanation:string>>, r array<struct<name:string,purpose:string>>")
    r = df.select(transforms.flatten_concepts(F.col("c")).alias("c"), transforms.flatten_resources(F.col("r")).alias("r")).first()
    assert r["c"] == ["a: why", "b"] and r["r"] == "x — use"


def test_dotted_paths(spark):
    df = spark.createDataFrame([((["x", "y"],),)], "a struct<b:array<string>>")
    get = lambda p: df.select(ingest.dotted(df.schema, p)[0]).first()[0]
    assert get("a.b.0") == "x" and get("a.b.-1") == "y" and get("a.b.7") is None
    assert ingest.dotted(df.schema, "a.z") is None and ingest.dotted(df.schema, "a.b.x") is None


def test_content_hash_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    cols = {"a": F.col("a"), "b": F.col("b")}
    some, listed = df.select(ingest.content_hash(cols), ingest.content_hash(cols, ("a", "b"))).first()
    assert some != listed and len(some) == 64


def test_empty_source(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("id,caption\n")
    c = parse_corpus("x", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [{"name": "s", "adapter": "csv", "location": str(tmp_path / "rows.csv"), "mapping": {"post_id": {"from": "id"}, "caption": {"from": "caption"}}, "provenance": {"source": "x", "media_ref": "m", "timestamp_field": "t"}, "dedupe": {"key": ["post_id"]}}]})
    (r,) = ingest.Pipeline(spark, c).run()
    assert r.added.isEmpty() and r.gaps.isEmpty()


def test_type_errors_are_gaps(spark):
    raw = spark.createDataFrame([(1, "a", 5, ["x", None]), (2, "b", None, ["x"])], "seq bigint, id string, caption bigint, concepts array<string>")
    c = parse_corpus("x", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [{"name": "s", "mapping": {"post_id": {"from": "id"}, "caption": {"from": "caption"}, "concepts": {"from": "concepts"}}, "provenance": {"source": "x", "media_ref": "m", "timestamp_field": "t"}}]})
    rows = {r["seq"]: (r["reason"], r["detail"]) for r in ingest.map_records(raw, c, c.sources[0]).collect()}
    assert rows[1] == ("mapping_error", "caption: not text") and rows[2][0] is None


def test_carried_forward_raises_without_payload(spark):
    skipped = spark.createDataFrame([(1, "a"), (2, "b")], "seq bigint, id string")
    with pytest.raises(Exception, match="no previous payload"):
        ingest.carried_forward(skipped, spark.createDataFrame([("a", "x")], "id string, owner string")).collect()


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    sinks.upsert(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "chunk_id string, v int, o int"), path, "chunk_id", "o")
    sinks.upsert(spark.createDataFrame([("b", 5, 1), ("c", 6, 1)], "chunk_id string, v int, o int"), path, "chunk_id")
    assert {(r["chunk_id"], r["v"]) for r in sinks.read_table(spark, path).collect()} == {("a", 2), ("b", 5), ("c", 6)}
    sinks.clear(spark, path)
    assert sinks.read_table(spark, path).count() == 0
    sinks.upsert(spark.createDataFrame([("d", 1, 1)], "chunk_id string, v int, o int"), path, "chunk_id")
    assert [tuple(r) for r in sinks.read_table(spark, path).collect()] == [("d", 1, 1)]
    with pytest.raises(Exception, match="dimensions"):
        sinks.write_vectors(spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>"), f"file://{tmp_path}/v", 2)
    assert sinks.write_json(tmp_path / "x.json", {"b": 1, "a": 2}) and not sinks.write_json(tmp_path / "x.json", {"a": 2, "b": 1})


def test_gold_and_lines(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"question_id": "q", "question": "x", "expected_post_ids": ["a"]}]))
    assert adapters.gold_questions(spark, str(tmp_path / "g.json")).first().asDict() == {"question_id": "q", "question": "x", "mode": "search", "difficulty": "medium", "expected": ["a"]}
    (tmp_path / "g.json").write_text(json.dumps([{"question_id": "q", "mode": "sing"}]))
    with pytest.raises(Exception, match="unknown mode"):
        adapters.gold_questions(spark, str(tmp_path / "g.json")).collect()
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert {r["a"] for r in adapters.json_lines(spark, str(tmp_path / "l.jsonl"), "a bigint").collect()} == {1, 2}


def test_stream_adds_once(spark, tmp_path):
    from lodestrata.streaming.ingest import ingest_stream

    c = parse_corpus("x", {"schema": {"schema_version": "1", "id_field": "post_id", "fields": FIELDS}, "sources": [{"name": "s", "mapping": {"post_id": {"from": "id"}, "caption": {"from": "caption"}}, "provenance": {"source": "x", "media_ref": "m", "timestamp_field": "t"}, "dedupe": {"key": ["post_id"]}}]})
    rows = spark.createDataFrame([(1, "a", "one"), (2, "a", "two"), (3, None, "no id"), (4, "b", "three")], "seq bigint, id string, caption string")
    rows.write.parquet(f"{tmp_path}/in")
    for n in range(2):
        raw = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = ingest_stream(raw, c, c.sources[0], f"{tmp_path}/out", f"{tmp_path}/cp{n}")
        q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/records").collect()) == ["a", "b"]
