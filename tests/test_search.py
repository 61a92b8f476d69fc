import json
import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.contract import parse_corpus
from lodestrata.errors import EmbeddingError, ModeError, QueryParamsError, RecordStoreRequired, RerankError, StaleCursorError, StaleViewError, ViewConfigError
from lodestrata.functions.text import content_words, index_tokens
from lodestrata.operators import chunk, evaluate, rank, vector, views
from lodestrata.operators.lexical import LexicalIndex, metadata_filter
from lodestrata.plans import gate, serve
from lodestrata.plans.params import QueryParams, SortKey, parse_filters, parse_sort

FIELDS = {"rec_id": {"type": "string"}, "owner": {"type": "string", "role": ["filter", "facet", "sort"]}, "tools": {"type": "list[string]", "role": ["filter", "facet"]}, "score": {"type": "int", "role": ["metric"]}, "good": {"type": "bool", "role": ["filter"]}, "summary": {"type": "text", "role": ["search"]}}
VIEWS = [
    {"name": "owners", "group_by": ["owner"], "metrics": [{"n": "count"}, {"mean_score": "mean(score)"}, {"share": "mean(good)"}]},
    {"name": "tools", "group_by": ["tools"], "metrics": [{"n": "count"}]},
    {"name": "seeded", "group_by": ["owner"], "metrics": [{"n": "count"}], "filters": {"owner": ["ann", "ghost"]}, "freshness": "30m"},
]
SPEC = {"schema": {"schema_version": "7", "id_field": "rec_id", "fields": FIELDS}, "index": {"retrieval": {"strategies": {"bm25": {}}, "max_top_k": 50}}, "materialize": {"freshness": "24h", "views": VIEWS}}
ROWS = [
    ("r1", "ann", ["figma", "sketch"], 9, True, "contrast ratios for accessible color"), ("r2", "ann", ["figma"], 7, False, "color palettes"), ("r3", "bob", [], 5, None, "grid systems"),
    ("r4", None, None, None, True, "color color color"), ("r5", "carol", ["blender"], 9, True, "naïve café lighting"), ("r6", "bob", ["figma", "figma"], 6, False, ""),
]


@pytest.fixture(scope="module")
def corpus():
    return parse_corpus("c", SPEC)


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "seq int, rec_id string, owner string, tools array<string>, score bigint, good boolean, summary string")
    p = F.struct(F.lit("src").alias("source"), F.lit("m").alias("media_ref"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("extractor"), F.lit(None).cast("double").alias("confidence"))
    return df.select("seq", F.col("rec_id").alias("id"), p.alias("provenance"), F.struct("rec_id", "owner", "tools", "score", "good", "summary").alias("fields")).cache()


def asked(spark, *questions):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "qid string, question string")


def test_chunks(spark, corpus, records):
    c = chunk.Chunker.of(corpus).chunks(records)
    assert c.count() == 5 and c.where("record_id = 'r6'").isEmpty()
    assert c.where("record_id = 'r1'").first()["chunk_id"] == "r1::summary::0"
    long = spark.createDataFrame([("a", "x" * 1000, None)], "id string, t string, u string").select("id", F.lit(None).cast("struct<media_ref:string>").alias("provenance"), F.struct("t", "u").alias("fields"))
    w = chunk.Chunker(("t", "u"), "by_size", 500, 100).chunks(long).orderBy("chunk_idx").collect()
    assert [len(r["text"]) for r in w] == [500, 500, 200] and [r["chunk_idx"] for r in w] == [0, 1, 2]
    for bad in (dict(fields=()), dict(fields=("a",), mode="odd"), dict(fields=("a",), max_chars=10, overlap=10)):
        with pytest.raises(ValueError):
            chunk.Chunker(**bad)


def test_document_text(spark):
    df = spark.createDataFrame([(([("a", "b"), ("c", None)], [("n", "p")], " x ", ["", "y"]),)], "fields struct<c:array<struct<term:string,explanation:string>>,r:array<struct<name:string,purpose:string>>,s:string,l:array<string>>")
    assert df.select(chunk.document_text(df, ["c", "r", "s", "l", "none"])).first()[0] == "a: b\nc\nn — p\n x \ny"


def test_tokens(spark):
    r = spark.createDataFrame([("Café_naïve-2 É",), (None,)], "t string").select(index_tokens(F.col("t"))).collect()
    assert r[0][0] == ["cafe", "naive", "2", "e"] and r[1][0] == []
    assert content_words("The ＡＢＣ of Straße") == ["abc", "strasse"]


def test_bm25(spark, corpus, records):
    index = LexicalIndex.build(chunk.Chunker.of(corpus).chunks(records))
    q = asked(spark, "color palettes", "color unicorn", "cafe", "— color", "grid-systems", "systems-grid", "", "color color")
    hits = {}
    for r in index.search(q, 10).orderBy("qid", "rank").collect():
        hits.setdefault(int(r["qid"]), []).append((r["record_id"], r["score"]))
    ids = {k: [i for i, _ in v] for k, v in hits.items()}
    assert ids[0] == ["r2"]  # all phrases
    assert set(ids[1]) == set(ids[3]) == {"r1", "r2", "r4"}  # none has all, so any
    assert ids[2] == ["r5"] and ids[4] == ["r3"] and 5 not in ids and 6 not in ids
    n, df, f, d, avg = 5, 3, 3, 3, (5 + 2 + 2 + 3 + 3) / 5
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    assert dict(hits[1])["r4"] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg)), abs=1e-9)
    assert dict(hits[7])["r4"] == pytest.approx(2 * dict(hits[1])["r4"], abs=1e-8)
    assert index.search(q, 0).isEmpty()
    only = index.search(asked(spark, "color"), 10, metadata_filter({"owner": "ann"}), prefilter=True)
    assert {r["record_id"] for r in only.collect()} == {"r1", "r2"}


def test_bm25_on_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id string, record_id string, text string")
    assert LexicalIndex.build(empty).search(asked(spark, "a"), 5).isEmpty()


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("c", [-1.0, 0.0])], "chunk_id string, embedding array<double>")
    top = vector.vector_search(v, [1.0, 0.0], 3).collect()
    assert [r["chunk_id"] for r in top] == ["a", "b", "z"] and top[2]["score"] == 0.0
    assert vector.vector_search(v, [1.0], 3, dims=2).isEmpty() and vector.vector_search(v, [1.0, 0.0], 0).isEmpty()
    e = spark.createDataFrame([("A b a",), ("",), (None,)], "text string").select(vector.hash_embedding(F.col("text"), 7)).collect()
    import hashlib

    want = [0.0] * 7
    for t in ("a", "b", "a"):
        want[int(hashlib.md5(t.encode()).hexdigest(), 16) % 7] += 1
    size = math.sqrt(sum(x * x for x in want))
    assert e[0][0] == pytest.approx([x / size for x in want]) and e[1][0] == e[2][0] == [0.0] * 7


def test_query_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "k bigint, embedding array<double>")
    q = v.where("k % 4 = 0").select(F.col("k").alias("qid"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vector.vector_search_many(v, q, 3, key="k").collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, vector.vector_search_many(v, q, 3, key="k").collect())) == whole and len(whole) == 30


def test_embedding_cache(spark):
    model = vector.hash_embedder(4)
    texts, cache = spark.createDataFrame([("a",), ("b",), ("b",)], "text string"), spark.createDataFrame([], "key string, embedding array<float>")
    first = vector.embed_cached(texts, cache, model)
    assert tuple(first.counts.first()) == (3, 0, 3) and first.added.count() == 2
    assert tuple(vector.embed_cached(texts, first.added, model).counts.first()) == (3, 3, 0)
    assert vector.embedding_cost(texts, first.added, model).first()["billable"] == 0
    with pytest.raises(EmbeddingError):
        vector.provider_embedder("m", 2, None).embed(texts)
    assert vector.provider_embedder("m", 1, lambda t: [[float(len(x))] for x in t]).embed(texts).first()["embedding"] == [1.0]


def test_fusion(spark):
    rows = [(0, "r1", "c1", 1), (0, "r2", "c2", 2), (1, "r2", "c3", 1), (1, "r1", "c4", 2), (1, "r1", "c5", 3)]
    out = rank.reciprocal_rank_fusion(spark.createDataFrame(rows, "list int, record_id string, chunk_id string, rank int"), []).orderBy("rank").collect()
    assert [(r["record_id"], r["chunk_id"]) for r in out] == [("r1", "c1"), ("r2", "c2")] and out[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def searcher(spark, hits):
    df = spark.createDataFrame([(r, f"{r}::0", s, i + 1) for i, (r, s) in enumerate(hits)], "record_id string, chunk_id string, score double, rank int")
    return lambda query, k: df.limit(k)


def test_serve(spark, corpus, records):
    find = searcher(spark, [(f"r{i}", 1 - i / 10) for i in range(1, 7)])
    params = lambda **kw: QueryParams(query="color", filters=parse_filters(corpus, kw.pop("filters", None)), sort=parse_sort(corpus, kw.pop("sort", None)), **kw)
    ids = lambda **kw: [h.record_id for h in serve.serve(corpus, find, params(**kw), records).hits]
    assert ids(filters={"tools": ["figma"]}) == ["r1", "r2", "r6"]
    assert ids(filters={"tools": {"op": "eq", "value": ["figma"]}}) == ["r2"]
    assert ids(filters={"score": {"op": "gte", "value": 7}}) == ["r1", "r2", "r5"]
    assert ids(filters={"score": {"op": "between", "value": [5, 7]}}) == ["r2", "r3", "r6"]
    assert ids(sort=[{"field": "score"}]) == ["r1", "r5", "r2", "r6", "r3", "r4"]
    assert ids(sort=[{"field": "owner", "order": "asc"}, {"field": "_score"}])[-1] == "r4"
    seen, cursor = [], None
    for _ in range(3):
        page = serve.serve(corpus, find, params(top_k=2, cursor=cursor), records)
        seen += [(h.record_id, h.rank) for h in page.hits]
        cursor = page.cursor
    assert seen == [(f"r{i}", i) for i in range(1, 7)] and cursor is None and page.total_matched == 6
    first = serve.serve(corpus, find, params(top_k=2), records).cursor
    for bad in (first[:-1] + "x", serve.mint_cursor("other", serve.fingerprint(params(top_k=2)), 2)):
        with pytest.raises(StaleCursorError):
            serve.serve(corpus, find, params(top_k=2, cursor=bad), records)
    with pytest.raises(StaleCursorError):
        serve.serve(corpus, find, params(top_k=3, cursor=first), records)
    with pytest.raises(ModeError):
        serve.serve(corpus, find, params(mode="magic"), records)
    with pytest.raises(RecordStoreRequired):
        serve.serve(corpus, find, params(sort=[{"field": "score"}]))
    assert serve.get("r2", records)["fields"]["owner"] == "ann" and serve.get("zz", records) is None
    assert serve.describe(corpus)["fields"]["score"]["roles"] == ["metric"]


def test_abstention(spark, corpus, records):
    run = lambda hits, query: serve.serve(corpus, searcher(spark, hits), QueryParams(query=query), records)
    assert not run([("r1", 0.9), ("r2", 0.5)], "contrast ratios").abstained
    assert run([("r1", 0.9), ("r2", 0.5)], "unicorn rainbow").reason == "insufficient_evidence"
    assert run([("r1", 1.0), ("r2", 0.999)], "contrast").abstained
    r = serve.serve(corpus, lambda q, k: searcher(spark, [("r1", 1.0)])(q, k).limit(0), QueryParams(query="x"), records)
    assert r.abstained and r.hits == []


@pytest.mark.parametrize("raw", [{"nope": 1}, {"owner": {"op": "gte", "value": 1}}, {"score": {"op": "in", "value": [1]}}, {"tools": []}, {"score": {"op": "between", "value": [1]}}, {"owner": {"op": "eq"}}, {"owner": {"op": "eq", "value": ["a"]}}, [1]])
def test_bad_filters(corpus, raw):
    with pytest.raises(QueryParamsError):
        parse_filters(corpus, raw)


def test_bad_sorts(corpus):
    for raw in ("score", [{"order": "asc"}], [{"field": "summary"}], [{"field": "score", "order": "up"}]):
        with pytest.raises(QueryParamsError):
            parse_sort(corpus, raw)
    assert parse_sort(corpus, [{"field": "_score"}]) == (SortKey("_score"),)


def test_hybrid_falls_back(spark):
    one = searcher(spark, [("r1", 2.0), ("r2", 1.0)])

    def broken(query, k):
        return one(query, k).withColumn("score", F.raise_error(F.lit("down")).cast("double"))

    assert [r["record_id"] for r in serve.hybrid(one, broken)("q", 5).collect()] == ["r1", "r2"]
    assert [r["record_id"] for r in serve.hybrid(one, searcher(spark, [("r3", 1.0), ("r2", 0.5)]))("q", 5).collect()] == ["r2", "r1", "r3"]
    with pytest.raises(RerankError):
        serve.rerank(one("q", 1), True)


def test_views(spark, corpus, records, tmp_path):
    by = {v.name: v for v in views.parse_views(corpus)}
    rows = {r["owner"]: r for r in views.materialize(by["owners"], records).collect()}
    assert (rows["ann"]["n"], rows["ann"]["mean_score"], rows["ann"]["share"]) == (2, 8.0, 0.5) and rows[None]["mean_score"] is None
    assert [p["record_id"] for p in rows["ann"]["provenance"]] == ["r1", "r2"] and rows["ann"]["schema_version"] == "7"
    assert {r["tools"]: r["n"] for r in views.materialize(by["tools"], records).collect()} == {"figma": 4, "sketch": 1, "blender": 1, None: 2}
    seeded = {r["owner"]: (r["n"], len(r["provenance"])) for r in views.materialize(by["seeded"], records).collect()}
    assert seeded == {"ann": (2, 2), "ghost": (0, 0)}
    clock = [datetime(2026, 1, 1, tzinfo=UTC)]
    m = views.ViewManager(spark, corpus, str(tmp_path), lambda: clock[0])
    with pytest.raises(StaleViewError):
        m.serve("owners")
    m.refresh(records)
    clock[0] += timedelta(minutes=31)
    assert m.serve("owners").count() == 4 and m.status()["seeded"]["stale"]
    with pytest.raises(StaleViewError):
        m.serve("seeded")
    clock[0] += timedelta(hours=24)
    with pytest.raises(StaleViewError):
        m.serve("owners")


@pytest.mark.parametrize("change", [{"group_by": ["score"]}, {"metrics": []}, {"metrics": [{"m": "sum(score)"}]}, {"metrics": [{"m": "mean(owner)"}]}, {"filters": {"summary": "x"}}, {"filters": {"owner": {"op": "gte", "value": 1}}}, {"freshness": "soon"}])
def test_bad_views(change):
    spec = json.loads(json.dumps(SPEC))
    spec["materialize"]["views"] = [VIEWS[0] | change]
    with pytest.raises(ViewConfigError):
        views.parse_views(parse_corpus("c", spec))


def test_metrics(spark):
    q = spark.createDataFrame([("q1", "search", ["a", "b", "c"]), ("q2", "abstain", []), ("q3", "search", [])], "question_id string, mode string, expected array<string>")
    hits = spark.createDataFrame([("q1", r, i + 1) for i, r in enumerate(["x", "a", "y", "raw_b"])], "question_id string, record_id string, rank int")
    m = {r["question_id"]: r for r in evaluate.question_metrics(q, hits, spark.createDataFrame([("raw_b", "b")], "raw_id string, gold_id string")).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert m["q1"]["ndcg_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal) and m["q1"]["mrr"] == 0.5 and m["q1"]["recall_5"] == pytest.approx(2 / 3)
    assert m["q3"]["recall_10"] == 0.0
    assert gate.evaluate(q, hits)["abstention_rate"] == 1.0


def test_gate(spark, tmp_path):
    v = gate.Versions("1", "1", "v1", {"model": "m"})
    base = gate.Baseline(v, "c", {m: 0.9 for m in gate.METRICS})
    assert gate.run_gate(v, {m: 0.89 for m in gate.METRICS}, base).decision == "pass"
    assert gate.run_gate(v, {"mrr": 0.9}, base).decision == "fail"
    drift = gate.run_gate(gate.Versions("2", "1", "v1", {"model": "m"}), {}, base)
    assert drift.decision == "abort" and drift.per_metric == {}
    path = gate.write_baseline(base, tmp_path / "b.json")
    assert gate.load_baseline(path).metrics == base.metrics
    (tmp_path / "bad.json").write_text("{}")
    q = spark.createDataFrame([("q1", "search", ["a"])], "question_id string, mode string, expected array<string>")
    hits = spark.createDataFrame([("q1", "a", 1)], "question_id string, record_id string, rank int")
    assert gate.quality_gate(q, hits, v, path, tmp_path / "out")[0] == 0
    assert gate.quality_gate(q, hits, v, tmp_path / "bad.json", tmp_path / "out")[0] == 3
    assert list((tmp_path / "out").glob("gate-*.json"))


def test_triage(spark):
    df = spark.createDataFrame([(1, "Hook and Viral reach, grow"), (2, "viral viral"), (3, None), (4, "hook viral")], "id int, t string")
    got = {r["id"]: (r["n_signals"], r["bucket"]) for r in evaluate.triage(df, F.col("t"), ["hook", "viral", "reach", "grow"]).collect()}
    assert got == {1: (4, "strong"), 4: (2, "medium")}


def test_cli(spark, corpus, records, tmp_path, capsys):
    import yaml

    from lodestrata import cli

    (tmp_path / "corpora").mkdir()
    (tmp_path / "corpora/c.yaml").write_text(yaml.safe_dump(SPEC))
    (tmp_path / "config.yaml").write_text("engine: {default_corpus: c}")
    records.write.parquet(f"{tmp_path}/records")
    chunk.Chunker.of(corpus).chunks(records).write.parquet(f"{tmp_path}/chunks")
    base = ["--config", f"{tmp_path}/config.yaml", "--records", f"{tmp_path}/records", "--chunks", f"{tmp_path}/chunks"]

    def call(*args):
        code = cli.main([*base, *args])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, out = call("--search", "color palettes")
    assert code == 0 and out["hits"][0]["record_id"] == "r2"
    assert call("--get", "r1")[1]["record"]["id"] == "r1" and call("--schema")[1]["corpus"] == "c"
    assert call("--search", "x", "--params", '{"filters": {"nope": 1}}')[0] == 2


def test_records_are_collapsed_before_the_cut(spark):
    from lodestrata.plans.serve import per_record

    rows = [(f"r{0 if i < 30 else i}", f"c{i:02}", 100.0 - i, i + 1) for i in range(34)]
    table = spark.createDataFrame(rows, "record_id string, chunk_id string, score double, rank int")
    search = per_record(lambda query, k: table.where(F.col("rank") <= k))
    assert [(r["record_id"], r["rank"]) for r in search("q", 3).orderBy("rank").collect()] == [("r0", 1), ("r30", 2), ("r31", 3)]
    assert search("q", 20).count() == 5
