"""Inputs with known results: fusion, keyword terms, bands, caps, chunking, reconciliation, capacity, digests."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as T
from quillspark.functions import vector as V
from quillspark.operators import chunking, documents, search, walk
from quillspark.streaming import changes


def unit(*v):
    v = np.array(v, float)
    return (v / np.linalg.norm(v)).tolist()


NOTES = [
    ("semantic-1", "关于知识管理的一般性思考", unit(1, 0.05, 0, 0)),
    ("semantic-2", "如何整理读书笔记与卡片", unit(0.95, 0.1, 0, 0)),
    ("semantic-3", "第二大脑与个人知识库", unit(0.9, 0.2, 0, 0)),
    ("hooks", "React 里 useEffect 的依赖数组要写全", unit(0, 0, 1, 0)),
    ("person", "张三在会议上提出了新的复盘流程", unit(0, 0, 0, 1)),
    ("project", "项目代号 Zettelkasten-X 的迁移计划", unit(0, 1, 0, 0)),
]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(i, n, n + ".md", n + ".md", d, v) for i, (n, d, v) in enumerate(NOTES)]
    return spark.createDataFrame(rows, "seq long, id string, doc_id string, path string, document string, embedding array<float>")


@pytest.mark.parametrize(
    "text, match, short",
    [
        ("useEffect 依赖", '"useeffect"', ("依赖",)),
        ("张三", None, ("张三",)),
        ("复盘流程", '"复盘流程" OR "复盘流" OR "盘流程"', ()),
        ("react-dom user_id a", '"react-dom" OR "user_id"', ()),
        ('say "hi" there', '"say" OR "there"', ()),
        ("", None, ()),
        (None, None, ()),
    ],
)
def test_keyword_terms(text, match, short):
    found = search.keyword_query(text)
    assert (found.match, found.short_terms) == (match, short)


def ids(df):
    return [r.id for r in df.orderBy("position").collect()]


def test_hybrid_finds_what_vectors_miss(notes):
    q = [1.0, 0, 0, 0]
    by_vector = ids(search.hybrid(notes, q, "", 3))
    assert by_vector == ["semantic-1", "semantic-2", "semantic-3"]
    for text, wanted in (("useEffect", "hooks"), ("张三", "person"), ("zettelkasten-x", "project")):
        rows = search.hybrid(notes, q, text, 3).collect()
        hit = next(r for r in rows if r.id == wanted)
        assert "keyword" in hit.matched_by and hit.distance > 1
    assert ids(search.hybrid(notes, q, "useEffect", 3, weight=0)) == by_vector
    assert len(ids(search.hybrid(notes, q, "nowhere", 3))) == 3


def test_fusion(spark):
    ranked = lambda *names: spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "id string, rank int")
    assert ids(search.fuse([(ranked("a", "b", "c"), 1.0), (ranked("c", "d"), 1.0)]))[0] == "c"
    assert ids(search.fuse([(ranked("a", "b"), 1.0), (ranked("b"), 0.0)])) == ["a", "b"]
    assert [search.clamp_weight(w) for w in (9, -1, "x", 2, float("nan"))] == [3, 0, 1, 2, 1]


def test_batch_search_equals_single_and_ignores_partitioning(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [0.25] * 48 if i % 50 == 0 else rng.normal(size=48).astype(np.float32).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, embedding array<float>")
    asked = df.where("seq % 35 = 0").withColumnRenamed("seq", "query_id")
    data = np.array([v for _, v in rows], np.float32).astype(float)
    expected = {(q, int(s), r + 1) for q in range(0, 700, 35) for r, s in enumerate(np.lexsort((np.arange(700), ((data - data[q]) ** 2).sum(1)))[:7])}
    for parts, block in ((1, 4096), (5, 64)):
        got = search.nearest_batch(df.repartition(parts), asked, 7, corpus_block=block, query_block=8)
        assert {(r.query_id, r.seq, r.rank) for r in got.collect()} == expected


def test_bands(spark):
    df = spark.createDataFrame([(0, i, d) for i, d in enumerate((0.4, 0.1, 0.3, 0.2))] + [(1, 0, 0.5), (2, 0, 0.1), (2, 1, 0.2)], "g int, seq int, distance double")
    got = {g: [r.band for r in search.bands(df, ["g"]).where(F.col("g") == g).orderBy("distance").collect()] for g in (0, 1, 2)}
    assert got == {0: ["strong", "related", "related", "exploratory"], 1: ["strong"], 2: ["strong", "exploratory"]}


@pytest.mark.parametrize(
    "per_document, other, hidden, expected",
    [
        (2, False, ["Hidden::0"], ["Source::1", "A::0", "A::1", "B::0"]),
        (2, True, [], ["Hidden::0", "A::0", "A::1", "B::0"]),
        (None, False, [], ["Hidden::0", "Source::1", "A::0", "A::1"]),
        (None, True, [], ["Hidden::0", "A::0", "A::1", "A::2"]),
    ],
)
def test_balanced_caps(spark, per_document, other, hidden, expected):
    rows = [("Hidden::0", 0.03), ("Source::1", 0.04), ("A::0", 0.05), ("A::1", 0.06), ("A::2", 0.07), ("B::0", 0.08)]
    df = spark.createDataFrame([(1, i, n, n.split("::")[0], n, d) for i, (n, d) in enumerate(rows)], "g int, seq int, id string, doc_id string, path string, distance double")
    got = search.balanced(search.visible(df, chunk_ids=hidden), ["g"], 4, per_document, F.col("doc_id") == "Source" if other else None)
    assert ids(got) == expected


def test_chunking_keeps_line_breaks(spark):
    text = "第一段第一句。\n\n第二段第一句。第二段第二句。第二段第三句。最后一句。"
    far = [0.1, 0.11, 0.12, 0.9]
    at = np.concatenate([[0], np.cumsum(np.arccos(1 - np.array(far)))])
    encode = lambda texts: np.stack([np.cos(at[: len(texts)]), np.sin(at[: len(texts)])], 1)
    assert np.percentile(far, 90) == pytest.approx(0.666)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = chunking.sentences(F.col("text"))
    said = [[[r["text"] for r in docs.select(parts.alias("p")).first()["p"]]]]
    got = spark.createDataFrame([(said,)], "said array<array<array<string>>>").select(chunking.encoded_distance(encode)("said")).first()[0][0][0]
    assert got == pytest.approx(far)
    chunks = docs.select(chunking.by_meaning(F.col("text"), parts, F.array(*[F.lit(d) for d in far]))).first()[0]
    assert chunks == ["第一段第一句。\n\n第二段第一句。 第二段第二句。 第二段第三句。", "最后一句。"]


def test_short_pieces_merge(spark):
    long = "x" * 60
    merge_short = lambda pieces: spark.createDataFrame([(pieces,)], "p array<string>").select(chunking.merge_short(F.col("p"))).first()[0]
    assert merge_short(["a", long, "b"]) == [f"a\n{long}\nb"]
    assert merge_short(["", "  ", "a"]) == ["a"]
    assert merge_short([long, long]) == [long, long]


def test_sizes_of_splits(spark):
    within = lambda text, limit: spark.createDataFrame([(text,)], "t string").select(chunking.within(F.col("t"), limit)).first()[0]
    parts = within("Sentence one. " * 300, 900)
    assert all(len(p) <= 900 for p in parts) and "".join(parts).replace(" ", "") == ("Sentence one. " * 300).replace(" ", "")
    assert within("y" * 2000, 900) == ["y" * 900, "y" * 900, "y" * 200]


def test_cleaning(spark):
    text = "---\na: 1\n---\n# Title\n> quote **bold** and `code`\n- item [[note|shown]] ![[img.png]]\n| a | b |\n|---|---|\n```py\nx = 1\n```\n1. one\n\n\n\nsee [link](http://x.y) https://z.w/a %%hidden%% $$m$$ ==mark== user_id[^1]"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.clean(F.col("t"))).first()[0]
    assert got.startswith("# Title\nquote bold and code\nitem shown")
    for gone in ("```", "hidden", "http", "==", "|", "[^1]", "_"):
        assert gone not in got
    assert "a   b" in got and "see link" in got


def test_chunks_of_documents(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "Some words here. " * 100 + "\n## B\nshort text of ten chars or more"), (2, None), (3, "tiny")], "doc_id long, text string")
    rows = chunking.chunk_documents(docs).orderBy("chunk_index").collect()
    assert {r.doc_id for r in rows} == {1}
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.chunk_count for r in rows} == {len(rows)}
    assert rows[-1].section_label == "A > B" and max(len(r.content) for r in rows) <= 951


def test_reconcile_and_verify(spark):
    schema = "doc_id string, path string, mtime double"
    selected = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 2.0), ("c", "c", 3.0)], schema)
    migrated = spark.createDataFrame([("a", "a", 1.0, True), ("b", "b", 1.0, True), ("d", "d", 1.0, True)], schema + ", complete boolean")
    assert {r.doc_id: r.action for r in documents.reconcile(selected, migrated).collect()} == {"a": "keep", "b": "reindex", "c": "reindex", "d": "delete"}
    counted = lambda df, n: df.withColumn("chunk_count", F.lit(n))
    assert documents.verify(counted(selected, 1), counted(selected, 1), counted(selected, 1)).count() == 0
    assert {r.violation for r in documents.verify(counted(selected, 0), counted(selected, 0), counted(selected, 0)).collect()} == {"stored but empty"}


def test_capacity(spark):
    rows = [(0, False)] + [(i, True) for i in range(1, 7)]
    got = documents.capacity_plan(spark.createDataFrame(rows, "position int, counts boolean"), 2495, 2500).orderBy("position").collect()
    assert [r.allowed for r in got] == [True] * 6 + [False]
    got = documents.capacity_plan(spark.createDataFrame(rows, "position int, counts boolean"), 2500, 2500).orderBy("position").collect()
    assert [r.allowed for r in got] == [True] + [False] * 6


def test_xor_digest(spark):
    names = ["a", "b", "c"]
    total = 0
    for n in names:
        total ^= int(hashlib.sha256(n.encode()).hexdigest(), 16)
    for order in (names, names[::-1]):
        assert documents.xor_digest(spark.createDataFrame([(n,) for n in order], "id string"), "id").first().digest == f"{total:064x}"


def test_paths(spark):
    rows = [("a/b.md",), ("/abs",), ("C:/x",), ("a//b",), ("../x",), ("a\\b.MD",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(T.relative_path(F.col("p"))).collect()]
    assert got == ["a/b.md", None, None, None, None, "a/b.MD", None]
    got = spark.createDataFrame([([" /a/ ", "a", "", "b\\c"],)], "p array<string>").select(T.normalize_excluded(F.col("p"))).first()[0]
    assert got == ["a", "b/c"]


def test_redaction(spark):
    text = "/Users/alice/Vault/notes/x.md and C:\\Users\\bob\\f mail me@x.org Bearer abc.defgh ?token=s3cret&x=1"
    got = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t"), "salt", "/Users/alice/Vault")).first()[0]
    for gone in ("alice", "bob", "me@x.org", "abc.defgh", "s3cret", "notes"):
        assert gone not in got
    assert "<root>/<file:" in got and "token=<token>" in got


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    got = row.select(V.squared_l2(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.normalize(F.col("a")), V.normalize(F.col("b"))).first()
    assert got[0] == 25 and got[1] == 0 and got[2] == pytest.approx([0.6, 0.8]) and got[3] == [0, 0]


def test_reachable_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in walk.reachable(edges, roots).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in walk.reachable(edges, roots, stop=spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b"}
    nodes, left = walk.hide(spark.createDataFrame([(n,) for n in "abcd"], "node string"), edges, "a", "c")
    assert {r.node for r in nodes.collect()} == {"a", "b"} and left.count() == 2


def test_layout(spark):
    df = spark.createDataFrame([(1, i, 100.0, 200.0) for i in range(3)], "g int, position int, parent_x double, parent_y double")
    assert [(r.x, r.y) for r in walk.child_places(df, ["g"]).orderBy("position").collect()] == [(670, -112), (670, 200), (670, 512)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}", start + timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 4, 9, 10, 30, 31, 60, 61))]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    batch = {(r.key, r.event_id, r.n) for r in changes.debounced(df, "key", "ts", 5).collect()}
    df.unionByName(spark.createDataFrame([(99, "end", start + timedelta(days=1))], df.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.debounced_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "ts", 5, "0 seconds")
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.event_id, r.n) for r in spark.table("debounced").collect() if r.key != "end"} == batch


def test_exit_windows_restart_at_their_first(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("w", start + timedelta(minutes=m)) for m in (0, 5, 9, 11, 20, 22)], "key string, ts timestamp")
    assert [r["count"] for r in changes.exit_windows(df, "key", "ts").orderBy("ts").collect()] == [1, 2, 3, 1, 2, 1]


def test_changes_apply_in_order_of_time(spark):
    state = spark.createDataFrame([("a", "a.md", 5.0, 2), ("b", "b.md", 5.0, 1)], "doc_id string, path string, mtime double, chunk_count int")
    feed = spark.createDataFrame([("a", "modify", "a.md", 4.0), ("b", "delete", "b.md", 6.0), ("c", "create", "c.md", 1.0), ("c", "modify", "c2.md", 2.0)], "doc_id string, op string, path string, mtime double")
    assert {tuple(r) for r in changes.apply_changes(state, feed).collect()} == {("a", "a.md", 5.0, 2), ("c", "c2.md", 2.0, 0)}


def test_vectors_that_have_no_distance(spark):
    """A vector that is not finite, or of another dimension, hides no other one: batched and single search agree."""
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 2.0, 3.0, 4.0]), (4, [float("inf"), 0.0]), (5, None), (6, []), (7, [2.0, 0.0])]
    records = spark.createDataFrame(rows, "seq long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])], "query_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in search.nearest_batch(records, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.seq, r.distance))
    assert got == {1: [(0, 1.0), (7, 4.0), (2, 9.0)], 2: [(3, 30.0)]}
    assert [(r.seq, r.distance) for r in search.nearest(records, [0.0, 0.0], 5).collect()] == got[1]


def test_fusion_without_weights(spark):
    ranks = spark.createDataFrame([("a", 1)], "id string, rank int")
    assert search.fuse([(ranks, 0.0), (ranks, 0.0)]).count() == 0
    assert [r.id for r in search.fuse([(ranks, 0.0), (ranks, 1.0)]).collect()] == ["a"]


def test_sizes_round_as_their_sql(spark):
    """Ties go to the even digit, and what only looks like a tie in decimals is none."""
    sizes = [1.25e9, 1.75e9, 1.15e9, 1.05e9, 9.95e9, 9.75e9, 99.95e9, 1e9, 999.95e9, 123456789.25e9, 1e9 - 1, 0.0, 2.0**53 * 1e9]
    rows = spark.createDataFrame([(float(s),) for s in sizes] + [(None,)], "size double").select(rules.format_bytes(F.col("size")))
    want = [f"{s / 1e9:.1f} GB" if s >= 1e9 else f"{max(1, int(s / 1e6 + 0.5))} MB" for s in sizes] + ["unknown"]
    assert [r[0] for r in rows.collect()] == want


def test_cuts_are_their_expressions(spark):
    """The functions over one text and the folds give the same, and a document's chunks come from the functions: some thirty times faster."""
    rng = random.Random(12)
    words = ["alpha", "Beta.", "gamma\n", "# delta", "\n## eps\n", "\n\n", "zeta!\u2003", "\u3000eta。", "\n#\ttheta \n", "\r\n", "iota?", "\u00a0", "x" * 700, "\n### kappa\n\nlambda. "]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(60)] + ["", " ", "# only a title", "é" * 5000, ". . . . "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    columns = [chunking.sections(F.col("t")), chunking.sentences(F.col("t")), chunking.within(F.col("t"), 900), chunking.merge_short(F.split("t", "\\."))]
    for t, r in zip(texts, df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()):
        got = chunking.text_sections(t), chunking.text_sentences(t), chunking.text_within(t, 900), chunking.text_merge_short(t.split("."))
        assert ([tuple(x) for x in r.c0], [tuple(x) for x in r.c1], r.c2, r.c3) == got, t
    parts = chunking.sentences(F.col("t"))
    said = F.transform(parts, lambda s: s["text"])
    far = F.when(F.size(said) > 1, chunking.word_distance(said)).otherwise(F.array().cast("array<double>"))
    short = [t[:790].strip(chunking.SPACES) for t in texts]
    df = spark.createDataFrame(list(enumerate(short)), "i int, t string").orderBy("i")
    want = [r[0] for r in df.select(chunking.by_meaning(F.col("t"), parts, far)).collect()]
    assert [chunking.text_by_meaning(t, chunking.neighbours(None)) for t in short] == want
    plan = chunking.chunk_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
