"""Problems 1, 2, 7, 9 and 10 against brute force, with the odd cases of the data."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import history, leakage, neardup, pieces, queries, repetition
from lodestrata.llm.shingles import words_of

VOCABULARY = [f"w{i}" for i in range(400)]


def text_of(rng, n=60):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, rate=0.04):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < rate else w for w in text.split())


def jaccard(a, b, n=3):
    def grams(t):
        w = words_of(t)
        m = min(n, len(w))
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [text_of(rng, rng.randint(20, 80)) for _ in range(n)]
    out = list(base)
    for t in base[:25]:
        out.append(edited(rng, t))
    out += [base[3]] * 6 + [base[5].upper().replace(" ", ", "), "", None, "   ", "two words", "Two words!", "one", "🙂", text_of(rng, 6000)]
    rng.shuffle(out)
    return out


# --- 1 ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\té́👩🏽‍💻字", max_size=900), st.integers(20, 120), st.integers(0, 9))
def test_spans_hold_the_limit_and_the_text(text, limit, overlap):
    out = pieces.spans(text, limit, overlap)
    assert (out == []) == (text == "")
    if out:
        assert out[0][0] == 0 and out[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in out)
        assert all(x[0] < y[0] <= x[1] < y[1] and x[1] - y[0] <= overlap for x, y in zip(out, out[1:]))


def test_cuts_are_natural():
    sentences = " ".join(f"Sentence number {i} ends here." for i in range(300))
    out = pieces.spans(sentences, 2000, 200)
    assert all(sentences[b - 1] == "." for _, b in out[:-1]) and all(sentences[a - 1] == " " for a, _ in out[1:])
    assert len(out) == -(-(len(sentences) - 200) // 1800)
    paragraphs = "\n\n".join("word " * 60 for _ in range(40))
    assert all(paragraphs[:b].endswith("\n\n") for _, b in pieces.spans(paragraphs, 2000, 200)[:-1])
    words = "abcdefg " * 2000
    assert all(words[b] == " " for _, b in pieces.spans(words, 2000, 200)[:-1])
    assert len(pieces.spans("x" * 5000, 2000, 200)) == 3


def test_pieces_rebuild_the_text(spark):
    rows = [("a", "word and more. " * 400, "clash"), ("b", "short", "x"), ("c", None, "x"), ("d", "", "x"), ("e", "字" * 4100, "x")]
    df = spark.createDataFrame(rows, "key string, text string, piece string")
    got = {}
    for r in pieces.split_oversized(df).orderBy("key", "piece_no").collect():
        assert len(r["piece"]) <= 2000 and r["end_char"] - r["start_char"] == len(r["piece"])
        got[r["key"]] = got.get(r["key"], "") + r["piece"][r["overlap_chars"] :]
    assert got == {"a": rows[0][1], "e": rows[4][1]}
    assert pieces.split_oversized(df.limit(0)).count() == 0
    assert {r["key"] for r in pieces.split_oversized(df, keep_small=True).collect()} == {"a", "b", "e"}
    with pytest.raises(ValueError):
        pieces.split_oversized(df, overlap=1000)


# --- 7 ---


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i] or "", texts[j] or "") >= 0.5}
    df = spark.createDataFrame([(i, t, "extra", 7) for i, t in enumerate(texts)], "id bigint, text string, class_id string, n int")
    found = neardup.near_duplicates(df)
    assert {(r["a"], r["b"]) for r in neardup.expanded(found).collect()} == want
    assert all(r["similarity"] >= 0.5 for r in found.pairs.collect())
    groups = {r["id"]: r for r in neardup.grouped(found).collect()}
    assert set(groups) == set(range(len(texts)))
    for i, j in want:
        assert groups[i]["group_id"] == groups[j]["group_id"]


def test_crowded_nodes_lose_nothing(spark, monkeypatch):
    rng = random.Random(5)
    shared = text_of(rng, 30)  # a third of the rows share a long head
    texts = [f"{shared} {text_of(rng, 20)}" for _ in range(30)] + [text_of(rng, 50) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    forest = neardup.plan_forest(0.3, 0.99)
    heads = neardup.signatures(df, forest).cache()
    for depth in (1, 2):
        whole, blocks = (neardup.met_at(heads, forest, depth, False, crowd).collect() for crowd in (10_000, 4))
        assert whole and sorted(whole) == sorted(blocks)


def test_shorter_prefixes_meet_only_what_did_not_meet(spark):
    texts = corpus(3, 60)
    heads = neardup.signatures(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), neardup.plan_forest()).cache()
    forest = neardup.plan_forest()
    met = {d: {tuple(r) for r in neardup.met_at(heads, forest, d, False).collect()} for d in (3, 4)}
    new = {tuple(r) for r in neardup.met_at(heads, forest, 3, True).collect()}
    assert met[4] | new == met[3]


def test_the_prefix_is_shortened_until_the_recall(spark):
    rng = random.Random(8)
    base = [text_of(rng, 80) for _ in range(60)]
    want, texts = set(), list(base)
    for i, t in enumerate(base):
        texts.append(edited(rng, t, 0.1))
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.5}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    ends = {}
    for target in (0.5, 0.995):
        found = neardup.near_duplicates(df, recall=target, forest=neardup.Forest(16, 5, 1, 0.5, 3, target))
        got = {(r["a"], r["b"]) for r in found.pairs.collect()}
        assert got <= want and found.recall >= target and len(got) >= (target - 0.1) * len(want)
        ends[target] = found.depth
    assert ends[0.995] < ends[0.5] == 5


def test_copies_are_paired_once_in_blocks(spark):
    df = spark.createDataFrame([(i, f"the same words in text {i // 40} again and again") for i in range(120)], "id bigint, text string")
    found = neardup.near_duplicates(df, threshold=0.95)
    got = [tuple(r) for r in neardup.expanded(found, limit=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(120) for j in range(i + 1, 120) if i // 40 == j // 40}


def test_near_duplicates_of_nothing(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "id bigint, text string"))
    assert neardup.expanded(found).count() == 0 and neardup.grouped(found).count() == 0


def test_forest_plan():
    f = neardup.plan_forest(0.5, 0.99)
    assert f.recall(0.5, f.end) >= 0.99 > f.recall(0.5, f.end + 1) and f.recall(0.5, f.begin) >= 0.5 and f.begin > f.end
    near = neardup.plan_forest(0.8, 0.99, words=5)
    assert near.end > f.end and near.recall(0.8, near.end) >= 0.99


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (99, 101)], "a bigint, b bigint")
    got = {r["id"]: r["group_id"] for r in neardup.components(pairs).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == got[99] == 99


# --- 2 ---


def brute_history(rows):
    kept, decisions = [], {}
    for seq, i, h, text in sorted(rows):
        hit = [k for k, hh, t in kept if h and hh == h or jaccard(t or "", text or "") >= 0.5]
        if seq >= 1000 and hit:
            decisions[i] = min(hit)
        else:
            kept.append((i, h, text))
    return decisions


def arrival_rows(seed):
    rng = random.Random(seed)
    texts = corpus(seed, 40)
    rows = []
    for i, t in enumerate(texts):
        h = f"{rng.randrange(30):064x}" if rng.random() < 0.5 else None
        rows.append((i + (0 if i < 40 else 1000), i, h, t))
    return rows


def frame(spark, rows):
    written = [lambda h: h, str.upper, lambda h: f"sha256:{h}"]
    return spark.createDataFrame([(i, s, f"uiux:{i % 50}#v2", written[i % 3](h) if h else ("broken" if i % 7 == 0 else None), t, 1) for s, i, h, t in rows], "id bigint, seq bigint, record_id string, content_hash string, text string, node int")


@pytest.mark.parametrize("seed, parts, limit", [(1, 1, 200_000), (2, 3, 200_000), (1, 1, 0), (2, 2, 20)])
def test_history_equals_brute_force(spark, monkeypatch, seed, parts, limit):
    monkeypatch.setattr(history, "MAX_IN_ONE_TASK", limit)
    rows = arrival_rows(seed)
    want = brute_history(rows)
    h = history.start(spark, frame(spark, [r for r in rows if r[0] < 1000]), buckets=4)
    late, got, ids = sorted(r for r in rows if r[0] >= 1000), {}, set()
    for p in range(parts):
        part = late[p * len(late) // parts : (p + 1) * len(late) // parts]
        for r in history.admit(h, frame(spark, part)).collect():
            ids.add(r["id"])
            if not r["accepted"]:
                got[r["id"]] = r["kept_id"]
    assert got == want and ids == {r[1] for r in late}


@pytest.mark.parametrize("limit, floor", [(200_000, 1_000_000), (200_000, 0), (0, 1_000_000), (20, 0)])
def test_ids_that_do_not_grow_with_arrivals(spark, monkeypatch, limit, floor):
    """Numbers of the history and of two arrivals lie among each other; the smallest accepted one is reported."""
    monkeypatch.setattr(history, "MAX_IN_ONE_TASK", limit)
    rng, numbers = random.Random(77), list(range(80))
    rng.shuffle(numbers)
    rows = [(0 if k < 40 else 1000 + k % 2, numbers[k], h, t) for k, (_, _, h, t) in enumerate(arrival_rows(1))]
    for k in range(12):  # a late row that both an old row (by hash or text) and a mate of its arrival refuse
        one, two, h, g = text_of(rng, 40), text_of(rng, 40), f"{1000 + k:064x}", f"{2000 + k:064x}"
        mate, late = [((g, two), (g, one)), ((None, two), (h, two)), ((None, two), (h, f"{two} once more"))][k % 3]
        rows += [(0, 900 + k, h, one), (1000, 300 + k, *mate), (1000, 600 + k, *late)]
    parts = [sorted((r for r in rows if r[0] == s), key=lambda r: r[1]) for s in (0, 1000, 1001)]
    want = brute_history(rows)
    assert all(want[600 + k] == 300 + k for k in range(12))
    h = history.start(spark, frame(spark, parts[0]), buckets=4, growing=False, pairs_floor=floor, pairs_per_row=200 if floor else 1)
    decided = [history.admit(h, frame(spark, part)).collect() for part in parts[1:]]
    got = {r["id"]: r["kept_id"] for part in decided for r in part if not r["accepted"]}
    assert got == want and sum(map(len, decided)) == len(rows) - len(parts[0])
    h.close()


def test_found_takes_rows_by_batch_and_then_by_number(spark, tmp_path):
    """Two corpora, numbered one after the other, in one table: batch 1 of the first comes after batch 0 of the second."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six", "red green blue grey pink teal"]
    made = [(0, 0, texts[0]), (1, 1, texts[1]), (2, 2, texts[1]), (3, 0, texts[1]), (4, 1, texts[2]), (5, 2, texts[3])]
    schema = "row_no bigint, batch_no int, id string, content_hash string, fields struct<caption: string, transcript: string, summary: string>"
    spark.createDataFrame([(i, b, f"r{i}", None, (t, None, None)) for i, b, t in made], schema).write.parquet(f"{tmp_path}/canonical_records.parquet")
    got = {(r[1], r[0]) for r in queries.p2_found(spark, str(tmp_path)).collect()}
    assert got == {(1, 3), (2, 3), (4, 0)}


def test_empty_arrival_and_hash_notations(spark):
    h = history.start(spark, frame(spark, arrival_rows(1)[:5]), buckets=2)
    assert history.admit(h, frame(spark, []) if False else frame(spark, arrival_rows(1)[:1]).limit(0)).count() == 0
    a = "ab" * 32
    df = spark.createDataFrame([(a,), (a.upper(),), (f" sha256:{a}",), ("x" * 64,), (None,)], "h string")
    got = [r[0] for r in df.select(F.hex(history.normal_hash(F.col("h")))).collect()]
    assert got[0] == got[1] == got[2] == a.upper() and got[3] is None and got[4] is None


def test_a_family_of_edited_copies_arrives_at_once(spark):
    """A third of all rows are one-word edits of one text; pairs stay bounded and results exact."""
    rng = random.Random(9)
    base = text_of(rng, 60).split()
    rows = []
    for i in range(1500):
        if i % 3 == 0:
            w = list(base)
            w[rng.randrange(60)] = f"edit{i}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, text_of(rng, 30)))
    frame_of = lambda part: spark.createDataFrame([(i, None, None, t) for i, t in part], "id bigint, record_id string, content_hash string, text string")
    h = history.start(spark, frame_of([(-1, "nothing like the others at all")]), block=16, pairs_per_row=2)
    h.pairs_floor = 2000
    got = {r["id"]: r["kept_id"] for r in history.admit(h, frame_of(rows)).collect()}
    family = [i for i, _ in rows if i % 3 == 0]
    assert len(got) == 1500 and all(got[i] is None for i in got if i % 3)
    kept, want = [], {}
    for i, t in rows:
        if i % 3 == 0:
            near = [k for k, x in kept if jaccard(x, t) >= 0.5]
            want[i] = min(near) if near else None
            if not near:
                kept.append((i, t))
    assert {i: got[i] for i in family} == want
    assert sum(h.admitted_pairs) < 60_000  # all pairs of the family would be 125,000 for each paragraph that they share
    # Later members meet the family in the history, in blocks.
    w = list(base)
    w[5] = "late"
    late = history.admit(h, frame_of([(5000, " ".join(w)), (5001, text_of(rng, 40))])).collect()
    assert {r["id"]: r["kept_id"] for r in late} == {5000: 0, 5001: None}
    with pytest.raises(ValueError):
        history.admit(h, frame_of([(3, "an old number")]))
    h.close()


def test_crowded_history_is_met_in_blocks(spark):
    """Rows that share a long paragraph with many others but are similar to few."""
    rng = random.Random(10)
    shared = text_of(rng, 9)
    rows = [(i, f"{shared}. {text_of(rng, 24)}") for i in range(200)]
    frame_of = lambda part: spark.createDataFrame([(i, None, None, t) for i, t in part], "id bigint, record_id string, content_hash string, text string")
    h = history.start(spark, frame_of(rows), block=8, coverage=0.01)
    late = [(1000 + i, edited(rng, rows[190 - i][1], 0.02)) for i in range(6)] + [(2000, f"{shared}. {text_of(rng, 24)}")]
    want = {}
    kept = list(rows)
    for i, t in late:
        near = [k for k, x in kept if jaccard(x, t) >= 0.5]
        want[i] = min(near) if near else None
        if not near:
            kept.append((i, t))
    assert {r["id"]: r["kept_id"] for r in history.admit(h, frame_of(late)).collect()} == want


@pytest.mark.parametrize("limit", [3, 10_000])
def test_rounds_settle_like_one_task(spark, monkeypatch, limit):
    """A chain: each row is similar to the one before only, so every second one is taken."""
    monkeypatch.setattr(history, "MAX_IN_ONE_TASK", limit)
    h = history.History(spark)
    nodes = spark.createDataFrame([(i, i, None) for i in range(12)], "node bigint, class bigint, chash binary")
    links = spark.createDataFrame([(i + 1, i) for i in range(9)], "a bigint, b bigint")
    got = {r["node"]: r["kept"] for r in history._in_order(h, nodes, links, 12).collect()}
    assert got == {i: (i - 1 if i % 2 and i < 10 else None) for i in range(12)}


# --- 9 ---


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [text_of(rng, n) for n in (30, 60, 13, 12, 200)]
    docs = [None, "", "🙂", text_of(rng, 300)]
    for _ in range(60):
        w = items[rng.randrange(5)].split()
        a = rng.randrange(max(1, len(w) - 13))
        part = w[a : a + rng.randint(9, 20)]
        docs.append(f"{text_of(rng, 20)} {' '.join(part).upper()} {text_of(rng, 5)}")
    docs.append("Straße café​ näive " + items[0])
    items.append("strasse cafe naive " + " ".join(items[0].split()[:10]))
    items.append(items[0])

    def grams(t):
        w = leakage.folded_words(t)
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, str(i)) for d, t in enumerate(docs) for i, x in enumerate(items) if grams(t) & grams(x)}
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "id bigint, text string, item_id string")
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "id string, text string")
    rows = leakage.leaks(d, q).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and all(r["leaked_words"] >= 13 for r in rows)
    assert max(r["leaked_words"] for r in rows if r["doc_id"] == len(docs) - 1) == 30
    assert leakage.leaks(d, q.limit(0)).count() == 0 and leakage.leaks(d.limit(0), q).count() == 0


def test_leaks_without_shipping(spark, monkeypatch):
    rng = random.Random(4)
    item = text_of(rng, 40)
    d = spark.createDataFrame([(1, text_of(rng, 30) + " " + item), (2, text_of(rng, 50))], "id bigint, text string")
    q = spark.createDataFrame([("a", item)], "id string, text string")
    monkeypatch.setattr(leakage, "MAX_SHIPPED", 1)
    assert [(r["doc_id"], r["leaked_words"]) for r in leakage.leaks(d, q).collect()] == [(1, 40)]


# --- 10 ---


def brute_share(text, run=8):
    w = words_of(text)
    seen, hit = set(), [0] * len(w)
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit[i : i + run] = [1] * run
        seen.add(g)
    return sum(hit) / len(w) if w else 0.0


def test_repetition(spark):
    rng = random.Random(6)
    texts = [None, "", "!!!", "a b", "spam and eggs for you and me today. " * 40, "word " * 300]
    for _ in range(60):
        t = text_of(rng, rng.randint(10, 200))
        texts.append(t + " " + " ".join(t.split()[: rng.randint(0, 60)]) if rng.random() < 0.4 else t)
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "id bigint, text string, repeated_share double")
    rows = {r["id"]: r for r in repetition.repetition(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        share = brute_share(t or "")
        assert rows[i]["repeated_share"] == pytest.approx(share)
        if share >= 0.3:
            assert rows[i]["p_repetitive"] >= 0.5
    assert rows[0]["p_repetitive"] is None and rows[2]["repeated_share"] == 0.0
    assert repetition.repetition(df.limit(0)).count() == 0


def test_the_posterior_decides_without_labels(spark):
    """Documents whose defined share abstains are told apart by the agreement of the other rules."""
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(240):
        if i % 3 == 0:  # a few sentences over and over between others: a share between the rule's limits
            stuck = [text_of(rng, 6) + ". " for _ in range(2)]
            own = [text_of(rng, 12) + ". " for _ in range(6)]
            text = "".join(own[j] + stuck[j % 2] * (2 if i % 2 else 3) for j in range(6))
        else:
            text = "".join(text_of(rng, rng.randint(6, 14)) + ". " for _ in range(12))
        rows.append((i, text))
        truth[i] = i % 3 == 0
    got = {r["id"]: r for r in repetition.repetition(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    right = sum((got[i]["p_repetitive"] >= 0.5) == t for i, t in truth.items())
    assert right >= 0.95 * len(rows)
    assert any(r["votes"][0] == 0 for r in got.values()) or all(0 < r["p_repetitive"] < 1 for r in got.values())
