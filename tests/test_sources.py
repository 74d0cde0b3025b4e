"""Sources beside the store, the keyword index, model services, streams of changes."""

import http.server
import io
import json
import os
import random
import tarfile
import threading
import time
import zipfile
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import chunking, keyword, search, walk
from quillspark.sources import connect
from quillspark.sources.store import Store, StoreError
from quillspark.streaming import changes


def test_notes_and_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("# Ä\ntext")
    (tmp_path / "TWO.MD").write_text("two")
    (tmp_path / "three.txt").write_text("three")
    notes = {r.path.rsplit("/", 1)[1]: r for r in connect.read_notes(spark, str(tmp_path)).collect()}
    assert set(notes) == {"one.md", "TWO.MD"} and notes["one.md"].text == "# Ä\ntext" and notes["one.md"]["size"] == 9
    assert connect.list_files(spark, str(tmp_path)).count() == 3


def test_paged_store_over_http(spark):
    records = [(f"r{i}", f"text {i}", {"n": i}, [float(i), 1.0]) for i in range(25)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(asked.query).items()}
            if asked.path == "/count":
                body = len(records)
            else:
                page = records[int(q["offset"]) :][: int(q["limit"])]
                body = {"ids": [r[0] for r in page]} | {c: [r[i] for r in page] for i, c in enumerate(("documents", "metadatas", "embeddings"), 1) if c in q["include"]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = connect.read_paged(spark, f"http://127.0.0.1:{server.server_port}", page=10)
        assert sorted((r.id, r.document, json.loads(r.metadata), list(r.embedding)) for r in rows.collect()) == sorted(records)
        assert rows.rdd.getNumPartitions() == 3
        only = connect.read_paged(spark, f"http://127.0.0.1:{server.server_port}", page=10, include="metadatas").collect()
        assert len(only) == 25 and all(r.document is None and r.embedding is None for r in only)
    finally:
        server.shutdown()


def test_state_file(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"a\\b.md": {"path": "a/b.md", "mtime": 5, "chunkCount": 2}, "c.md": {"mtime": 6, "chunkCount": 0, "muted": True}}))
    rows = {r.doc_id: r for r in connect.read_state(spark, str(path)).collect()}
    assert set(rows) == {"a/b.md", "c.md"} and rows["c.md"].muted and not rows["a/b.md"].muted
    path.write_text(json.dumps({"a\\b": {"mtime": 5}, "a/b": {"mtime": 6}}))
    with pytest.raises(ValueError):
        connect.read_state(spark, str(path))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one", "1")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x/one")
        info.size = 2
        t.addfile(info, io.BytesIO(b"22"))
    rows = connect.archive_entries(spark, str(tmp_path), expected=["x/one"]).collect()
    assert sorted((r.entry, r["size"], bytes(r.content)) for r in rows) == [("x/one", 1, b"1"), ("x/one", 2, b"22")]
    with pytest.raises(Exception, match="unexpected"):
        connect.archive_entries(spark, str(tmp_path), expected=["y"]).collect()


def test_cut_vectors_and_uneven_batches_fail(spark):
    with pytest.raises(Exception, match="cut short"):
        spark.createDataFrame([(bytearray(b"12345"),)], "b binary").select(connect.float_size(F.col("b"))).collect()
    with pytest.raises(Exception, match="length"):
        connect.unpack_batches(spark.createDataFrame([(["a", "b"], ["x"])], "ids array<string>, documents array<string>")).collect()


def test_summaries_fall_back(spark):
    def ask(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return "" if "mute" in prompt else "```text\nshort\n```"

    docs = spark.createDataFrame([(1, " long text "), (2, "bad"), (3, "mute"), (4, "  ")], "id int, text string")
    rows = {r.id: r for r in connect.summarized(docs, ask, "Sum up: {page_content}").collect()}
    assert (rows[1].query_text, rows[1].used_summary, rows[1].error) == ("short", True, None)
    assert (rows[2].query_text, rows[2].used_summary, rows[2].error) == ("bad", False, "no answer")
    assert (rows[3].query_text, rows[3].error) == ("mute", "empty summary") and (rows[4].query_text, rows[4].error) == ("", None)
    with pytest.raises(Exception, match="no answer"):
        connect.summarized(docs, ask, "{page_content}", fall_back=False).collect()


def test_packs_and_encoders(spark):
    assert list(chunking.packs(["a" * 1000, "b" * 900, "c", "d", "e", "f", "g", "h" * 5000])) == [["a" * 1000], ["b" * 900, "c", "d", "e"], ["f", "g"], ["h" * 5000]]

    def picky(texts):
        if len(texts) > 1:
            raise ValueError("one at a time")
        return chunking.hashing_encoder(texts)

    assert (chunking.encode_pack(["a b", "c"], picky) == chunking.hashing_encoder(["a b", "c"])).all()
    with pytest.raises(ValueError):
        chunking.encode_pack(["a", "b"], lambda texts: chunking.hashing_encoder(texts[:1]))
    root = walk.free_text("some words", chunking.embed, spark).first()
    assert root.id == "transient::chunk-0" and len(root.embedding) == 64


def test_keyword_index_grows_and_finds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ensure("notes")
    vector = [1.0, 0.0]
    texts = {"a": "the quick brown fox", "b": "a slow brown ox", "c": "useEffect and deps", "d": "nothing here"}
    store.upsert("notes", spark.createDataFrame([(i, t, vector) for i, t in texts.items()], "id string, document string, embedding array<float>"))
    index = keyword.KeywordIndex(store, "notes", f"file://{tmp_path}/index")
    assert index.status() == {"state": "backfilling", "indexed": 0, "total": 4}
    assert index.backfill(limit=3) and not index.backfill(limit=3) and not index.backfill()
    assert index.status() == {"state": "ready", "indexed": 4, "total": 4}
    assert [r.id for r in index.search(["useeffect"]).collect()] == ["c"]
    want = [(r.id, round(r.score, 9)) for r in search.bm25(store.read("notes"), ["brown", "ox"]).collect()]
    assert [(r.id, round(r.score, 9)) for r in index.search(["brown", "ox"]).collect()] == want
    changed = spark.createDataFrame([("d", "now brown too", vector)], "id string, document string, embedding array<float>")
    store.upsert("notes", changed)
    index.replaced(changed)
    assert {r.id for r in index.search(["brown"]).collect()} == {"a", "b", "d"}


def test_keyword_index_is_the_scan(spark, tmp_path, monkeypatch):
    """Through backfill, changes, deletions and merges, also where the index is behind: the same as scanning all texts."""
    monkeypatch.setattr(keyword, "BUCKETS", 3)
    rng = random.Random(4)
    words = ["the", "einen", "thethe", "brown", "x", "ß-ñ", "aaaa", "ox", "\U0001f600é", "Lichkeit", "qui"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    make = lambda ids: spark.createDataFrame([(i, i, text() if rng.random() < 0.9 else None, [1.0]) for i in ids], "id string, doc_id string, document string, embedding array<float>")
    store = Store(spark, f"file://{tmp_path}/store")
    store.ensure("notes")
    index = keyword.KeywordIndex(store, "notes", f"file://{tmp_path}/index")
    assert index.search(["the"], 3).count() == 0 and index.status()["state"] == "unavailable" and not index.backfill()

    def same():
        for terms, k in ((["the"], 5), (["einen", "the", "Lichkeit", "aaa", "\U0001f600é ", "nowhere"], None)):
            want = [(r.id, round(r.score, 9)) for r in search.bm25(store.read("notes"), terms, k).collect()]
            assert [(r.id, round(r.score, 9)) for r in index.search(terms, k).collect()] == want, terms

    store.upsert("notes", make([f"d{i}" for i in range(30)]))
    same()  # nothing is indexed yet
    assert index.backfill(20)
    store.upsert("notes", make(["d3", "d25", "d40"]))
    store.delete_document("notes", "d4")
    same()  # behind in both ways
    index.follow()
    while index.backfill(20):
        pass
    assert index.status() == {"state": "ready", "indexed": 30, "total": 30}
    index.merge()
    same()
    assert index.follow() == store.version("notes")


def test_spans_that_cannot_win_are_not_read(spark, monkeypatch):
    """Single trigrams: the first spans give a bound, and only spans that reach it are scored after them."""
    rows = [(i, "the end" if i % 2 else "an end") for i in range(40 * keyword.SPAN)] + [(50_000 + i, "the the the") for i in range(5)]
    records = spark.createDataFrame(rows, "seq long, document string")
    index = keyword.blocks(keyword.postings(records)).cache()
    n, average = keyword.lengths(records).agg(F.count("*"), F.avg("dl")).first()
    scored, plain = [], keyword.term_hits
    monkeypatch.setattr(keyword, "term_hits", lambda index, terms, *a: (scored.append(index.select("span").distinct().count()), plain(index, terms, *a))[1])
    got = [(r.seq, round(r.score, 9)) for r in keyword.top(index, ["the"], n, average, 5).collect()]
    assert got == [(r.seq, round(r.score, 9)) for r in search.bm25(records, ["the"], 5).collect()]
    assert sum(scored) <= keyword.FIRST_SPANS + 1 and index.select("span").distinct().count() > 40


def test_a_table_of_queries_is_as_many_queries(spark):
    """500 queries in one job; those of each kind of terms are asked alone as well."""
    rng = random.Random(6)
    words = ["the", "einen", "brown", "aaaa", "Lichkeit", "qui", "ox", "ende", "straße"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    records = spark.createDataFrame(docs, "seq long, document string")
    index = keyword.blocks(keyword.postings(records)).cache()
    n, average = keyword.lengths(records).agg(F.count("*"), F.avg("dl")).first()
    asked = [(q, [rng.choice(words + ["nowhere", "aaa"]) for _ in range(rng.randint(0, 4))]) for q in range(500)]
    got = {}
    for r in keyword.top_batch(index, spark.createDataFrame(asked, "query_id long, terms array<string>"), n, average, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.seq, round(r.score, 9)))
    for q, terms in asked[:8]:
        want = keyword.top(index, terms, n, average, 5).collect()
        assert sorted(got.get(q, [])) == [(i, r.seq, round(r.score, 9)) for i, r in enumerate(want, 1)], terms
    alike = {}
    for q, terms in asked:
        alike.setdefault(tuple(dict.fromkeys(t.lower() for t in terms)), []).append(sorted(got.get(q, [])))
    assert all(len({str(x) for x in same}) == 1 for same in alike.values()) and len(alike) > 100


def test_time_of_a_batch_and_links(spark, tmp_path):
    def slow(texts):
        time.sleep(0.6 if "slow" in texts else 0)
        return chunking.hashing_encoder(texts)

    assert (chunking.encode_pack(["a", "b"], slow, 0.3) == chunking.hashing_encoder(["a", "b"])).all()
    with pytest.raises(TimeoutError):
        chunking.encode_pack(["a", "slow"], slow, 0.3)  # no second try text by text
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.bin").write_bytes(b"123")
    assert [r.length for r in connect.list_files(spark, f"file://{tmp_path}/in").collect()] == [3]
    (tmp_path / "in/deep/b.bin").symlink_to(tmp_path / "in/deep/a.bin")
    with pytest.raises(ValueError, match="symbolic link"):
        connect.list_files(spark, f"file://{tmp_path}/in")


def test_a_walk_from_a_text_that_is_not_stored(spark):
    rows = chunking.embed(spark.createDataFrame([(i, i, "d", t) for i, t in enumerate(["brown foxes", "brown fox", "blue sea"])], "id string, seq long, doc_id string, document string"), "document")
    root = walk.free_text("brown fox", chunking.embed, spark)
    found = walk.related(rows, "transient::chunk-0", root=root).orderBy("position").collect()
    assert [r.id for r in found] == ["1", "0"] and walk.related(rows, "transient::chunk-0").count() == 0
    assert [r.id for r in walk.related(rows, "transient::chunk-0", root=root, valid=F.col("id") != "1").orderBy("position").collect()] == ["0", "2"]


def test_meta_types_and_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ensure("notes")
    assert store.open("other") is None and store.get_meta("format") == "1"
    rows = spark.createDataFrame([("a", '{"n": 1, "t": "1", "b": true, "none": null}', [1.0]), ("b", None, [2.0])], "id string, metadata string, embedding array<float>")
    store.upsert("notes", rows)
    ids = lambda **w: [r.id for r in store.get("notes", where=w).collect()]
    assert ids(n=1) == ids(n=1.0) == ids(t="1") == ids(b=True) == ["a"] and ids(n="1") == ids(t=1) == ids(b="true") == ids(none=0) == []
    with pytest.raises(StoreError):
        store.upsert("notes", spark.createDataFrame([("c", '{"deep": [1]}', [1.0])], "id string, metadata string, embedding array<float>"))
    held = store.cached("notes")
    assert store.cached("notes") is held
    for i in range(3):
        store.upsert("notes", spark.createDataFrame([(f"x{i}", [1.0])], "id string, embedding array<float>"))
    assert store.cached("notes") is not held
    store.vacuum("notes")
    named = {p["data"] for n in (3, 4) for p in store.state("notes", n)["parts"]}
    assert store.count("notes") == store.read("notes").count() == 5 and {f.name for f in (tmp_path / "store/notes").glob("v*")} == named
    store.compact("notes", whole=True)
    store.vacuum("notes", keep=1)
    assert store.read("notes").count() == 5 and len(list((tmp_path / "store/notes").glob("v*"))) == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"op": "modify", "path": "a.md", "ts": "2024-01-01T00:00:00Z"}, {"op": "modify", "path": "a.txt", "ts": "2024-01-01T00:00:00Z"}, {"op": "rename", "path": "b.txt", "old_path": "b.md", "ts": "2024-01-01T00:00:01Z"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    seen = []
    changes.save_every(changes.read_changes(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert sorted(seen) == ["a.md", "b.txt"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/1").write_text('{"status": "pulling", "total": 5}\nnot json\n')
    got = []
    connect.stream_lines(spark, str(tmp_path / "lines"), "status string, total long").writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(120)
    assert sorted((r.status or "", r.total or 0) for r in got) == [("", 0), ("pulling", 5)]


def test_query_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    for at, n in ((1, 3), (2, 0)):
        connect.write_query_log(spark.createDataFrame([(at, "search", n, "secret text")], "at long, tool string, results int, query string"), folder)
    assert connect.last_query(spark, folder).collect() == [(2, "search", 0)]


def test_free_rows_are_found(spark):
    """Children keep a row's distance from what stands in their column already."""
    rows = spark.createDataFrame([("w", i, 0.0, 0.0, [0.0]) for i in range(3)], "walk string, position int, parent_x double, parent_y double, taken array<double>")
    got = [(r.x, r.y) for r in walk.free_places(rows, ["walk"]).orderBy("position").collect()]
    assert got == [(570.0, -312.0), (570.0, 312.0), (570.0, 624.0)]


def test_rules_of_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    from quillspark.functions import text as T

    assert one(rules.composed(F.lit("e\u0301"))) == "é"
    assert one(T.truncate_utf8(F.lit("aé" * 10), 8)) == "aéaéa…" and one(T.truncate_utf8(F.lit("abc"), 8)) == "abc"
    assert one(T.redact(F.lit("key ABC-12345678 at C:\\x\\y"), license_prefix="ABC")) == "key <license-key> at <path>"
    assert one(rules.folder_in(F.lit("/v"), F.lit("/v/a/../b"))) is None


def _texts(n):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    return [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(n)], words


def _shuffled(spark):
    """Bytes that stages have written for shuffles so far."""
    jsc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    jsc.listenerBus().waitUntilEmpty()
    stages = jsc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture(scope="module")
def built_index(spark, tmp_path_factory):
    """The index that the queries build, of texts in files: (its folder, bytes shuffled, characters)."""
    from quillspark.plans import indexing

    folder, (docs, _) = tmp_path_factory.mktemp("built"), _texts(600)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    before = _shuffled(spark)
    index, n, average = indexing._index(spark, str(folder))
    return index, n, average, _shuffled(spark) - before, sum(len(t) for _, t in docs)


def test_building_the_index_shuffles_nothing_and_is_small(built_index):
    """Postings were shuffled one by one, with places of four bytes and a length each."""
    index, _, _, shuffled, chars = built_index
    size = sum(os.path.getsize(p.removeprefix("file://")) for p in index.inputFiles())
    assert shuffled < 2000 and size < 3 * chars, (shuffled, size, chars)


def test_a_phrase_is_counted_where_its_span_meets(spark, built_index):
    """Phrases: the blocks of a span meet packed, not the places of each record."""
    index, n, average, _, chars = built_index
    docs, words = _texts(600)
    records, terms = spark.createDataFrame(docs, "seq long, document string"), [w for w in words if len(w) > 5][:3]
    before = _shuffled(spark)
    got = [(r.seq, round(r.score, 9)) for r in keyword.top(index, terms, n, average, 20).collect()]
    written = _shuffled(spark) - before
    assert got == [(r.seq, round(r.score, 9)) for r in search.bm25(records, terms, 20).collect()] and len(got) == 20
    assert written < chars / 8, (written, chars)


def test_spans_of_several_tasks_are_whole(spark):
    """Records out of order: a span has blocks of each task that met it, and bounds don't add them up."""
    docs, words = _texts(600)
    records = spark.createDataFrame(docs, "seq long, document string").repartition(5, "document")
    index = keyword.index_blocks(records).cache()
    assert index.groupBy("gram", "span").count().where("count > 1").count() > 0
    n, average = keyword.lengths(records).agg(F.count("*"), F.avg("dl")).first()
    for terms in ([words[0][:3], words[1][:3]], [words[2], words[3][:4], words[4][:3]]):
        want = [(r.seq, round(r.score, 9)) for r in search.bm25(records, terms, 7).collect()]
        assert [(r.seq, round(r.score, 9)) for r in keyword.top(index, terms, n, average, 7).collect()] == want


def test_a_batch_of_queries_shuffles_packed_blocks(spark, built_index):
    """Each hit of each trigram was shuffled with its places."""
    index, n, average, _, chars = built_index
    _, words = _texts(600)
    asked = spark.createDataFrame([(q, words[2 * q : 2 * q + 2]) for q in range(100)], "query_id long, terms array<string>")
    before = _shuffled(spark)
    got = keyword.top_batch(index, asked, n, average, 5).collect()
    written = _shuffled(spark) - before
    assert len(got) == 500 and written < 3 * chars, (len(got), written, chars)
    alone = keyword.top(index, words[2:4], n, average, 5).collect()
    assert sorted((r.rank, r.seq, round(r.score, 9)) for r in got if r.query_id == 1) == [(i, r.seq, round(r.score, 9)) for i, r in enumerate(alone, 1)]


def test_a_hybrid_batch_shuffles_packed_blocks(spark, built_index):
    """Vectors and words of a hundred queries: each hit of each trigram was shuffled with its places."""
    index, n, average, _, chars = built_index
    _, words = _texts(600)
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(600)], "seq long, embedding array<float>")
    asked = spark.createDataFrame([(q, words[2 * q : 2 * q + 2], [rng.random() for _ in range(4)]) for q in range(100)], "query_id long, terms array<string>, embedding array<float>")
    before = _shuffled(spark)
    got = keyword.hybrid_batch(index, vectors, asked, n, average, 5).collect()
    written = _shuffled(spark) - before
    assert len(got) == 500 and written < 4 * chars, (len(got), written, chars)
