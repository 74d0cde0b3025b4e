import random

import pytest

from quillspark.sources.store import Store, StoreError, copy_collection


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.ensure("notes")
    return s


def rows(spark, *ids, title="t", vector=(1.0, 0.0)):
    return spark.createDataFrame([(i, i.split("#")[0], f"{i} text", title, {"lang": "en"}, list(vector)) for i in ids], "id string, doc_id string, document string, title string, metadata map<string,string>, embedding array<float>")


def test_upsert_keeps_places(spark, store):
    store.upsert("notes", rows(spark, "a#0", "b#0", "c#0"))
    store.upsert("notes", rows(spark, "a#0", title="new"))
    got = store.get("notes").collect()
    assert [r.id for r in got] == ["a#0", "b#0", "c#0"] and got[0].title == "new"


@pytest.mark.parametrize("vector", [(1.0, 0.0, 0.0), (float("nan"), 0.0)])
def test_invalid_batches_change_nothing(spark, store, vector):
    store.upsert("notes", rows(spark, "a#0"))
    with pytest.raises(StoreError):
        store.upsert("notes", rows(spark, "b#0", vector=vector))
    with pytest.raises(StoreError):
        store.upsert("notes", rows(spark, "b#0", "b#0"))
    assert store.count("notes") == 1


def test_filters_and_paging(spark, store):
    store.upsert("notes", rows(spark, "a#0", "a#1", "b#0"))
    assert [r.id for r in store.get("notes", where={"doc_id": "a"}).collect()] == ["a#0", "a#1"]
    assert store.get("notes", where={"lang": {"$eq": "en"}}).count() == 3
    assert store.get("notes", ids=[]).count() == 0
    assert [r.id for r in store.get("notes", limit=1, offset=1).collect()] == ["a#1"]
    assert "embedding" not in store.get("notes").columns
    with pytest.raises(StoreError):
        store.get("notes", where={"x": {"$gt": 1}})


def test_delete_drop_and_names(spark, store):
    store.upsert("notes", rows(spark, "a#0", "a#1", "b#0"))
    assert store.delete_document("notes", "a") == 2 and store.delete_document("notes", "a") == 0
    assert store.document_entries("notes").count() == 1
    with pytest.raises(StoreError):
        store.ensure("x")
    assert store.drop("notes") and not store.drop("notes")


def test_copy(spark, store, tmp_path):
    store.upsert("notes", rows(spark, "a#0", "b#0"))
    assert copy_collection(store, Store(spark, f"file://{tmp_path}/other"), "notes") == {"source": 2, "target": 2, "same_ids": True, "differing": 0}


# The log of deltas.


def state_of(store):
    """id -> (seq, title), by reading, checked against the count that the log keeps."""
    got = {r.id: (r.seq, r.title) for r in store.read("notes").collect()}
    assert len(got) == store.count("notes")
    return got


def part_rows(store, tmp_path, spark):
    return [spark.read.parquet(str(tmp_path / "store/notes" / p["data"])).count() for p in store.state("notes")["parts"]]


def test_a_batch_writes_its_own_size(spark, store, tmp_path):
    store.upsert("notes", rows(spark, *[f"d{i}#0" for i in range(50)]))
    store.upsert("notes", rows(spark, "d3#0", "d7#0", "e#0", title="new"))
    assert part_rows(store, tmp_path, spark) == [50, 3]
    assert store.delete_document("notes", "d3") == 1
    assert part_rows(store, tmp_path, spark) == [50, 3, 1]
    got = state_of(store)
    assert "d3#0" not in got and got["d7#0"][1] == "new" and got["d8#0"][1] == "t" and got["e#0"] == (50, "new")
    store.upsert("notes", rows(spark, "d3#0"))
    assert state_of(store)["d3#0"][0] == 51  # a deleted record comes back behind all others
    assert len(store.read("notes", 1).collect()) == 50  # readers of an older version still see it


def test_random_batches_and_merges(spark, store):
    """Batches of upserts and deletes against a dictionary, through several merges of parts."""
    rng, want, top = random.Random(3), {}, 0
    for step in range(14):
        ids = sorted({f"d{rng.randrange(12)}#{rng.randrange(3)}" for _ in range(rng.randint(1, 8))})
        if step % 4 == 3:
            docs = {i.split("#")[0] for i in ids[:3]}
            gone = [i for i in want if i.split("#")[0] in docs]
            assert store.delete_documents("notes", spark.createDataFrame([(d,) for d in docs], "doc_id string")) == len(gone)
            for i in gone:
                del want[i]
        else:
            store.upsert("notes", rows(spark, *ids, title=str(step)))
            for i in ids:
                want[i] = (want[i][0] if i in want else (top := top + 1) - 1, str(step))
        if step % 5 == 4 or step == 13:
            assert state_of(store) == want
    assert len(store.state("notes")["parts"]) <= 9
    assert store.compact("notes", whole=True) and len(store.state("notes")["parts"]) == 1 and state_of(store) == want


def test_a_writer_that_dies_leaves_the_collection_usable(spark, store, tmp_path, monkeypatch):
    store.upsert("notes", rows(spark, "a#0"))

    def die(*a, **k):
        raise RuntimeError("killed")

    for step in ("_write", "_commit"):  # before its files are whole, and before its commit is there
        with monkeypatch.context() as m:
            m.setattr(Store, step, die)
            with pytest.raises(RuntimeError):
                store.upsert("notes", rows(spark, "b#0"))
            with pytest.raises(RuntimeError):
                store.delete_document("notes", "a")
        assert list(state_of(store)) == ["a#0"]
    (tmp_path / "store/notes/v2-dead").mkdir()
    (tmp_path / "store/notes/commits/000000000002").touch()  # a writer of another kind died between create and close
    (tmp_path / "store/notes/commits/.x.part").write_text("half")
    assert list(state_of(store)) == ["a#0"]
    store.upsert("notes", rows(spark, "b#0"))
    store.vacuum("notes")
    assert set(state_of(store)) == {"a#0", "b#0"} and not (tmp_path / "store/notes/v2-dead").exists()
    (tmp_path / "store/meta/format/000000000001").touch()
    assert store.get_meta("format") == "1"
    store.set_meta("k", "one")
    (tmp_path / "store/meta/k/000000000001").touch()
    store.set_meta("k", "two")
    assert store.get_meta("k") == "two" and Store(spark, store.root).count("notes") == 2


def test_two_writers(spark, store, monkeypatch):
    """Another writer commits between this one's reading and its commit: both batches stay."""
    other, plain, once = Store(spark, store.root), Store._commit, []

    def late(self, folder, number, text):
        if self is store and folder.endswith("notes/commits") and not once:
            once.append(1)
            other.upsert("notes", rows(spark, "b#0", "c#0", title="other"))
        plain(self, folder, number, text)

    monkeypatch.setattr(Store, "_commit", late)
    store.upsert("notes", rows(spark, "a#0", "b#0", title="mine"))
    assert state_of(store) == {"b#0": (0, "mine"), "c#0": (1, "other"), "a#0": (2, "mine")}


def test_changes(spark, store):
    store.upsert("notes", rows(spark, "a#0", "b#0"))
    since = store.version("notes")
    store.upsert("notes", rows(spark, "b#0", "c#0", title="new"))
    store.delete_document("notes", "a")
    store.compact("notes", whole=True)
    got = [(r.version - since, r.kind, r.id, r.seq, r.doc_id, r.title) for r in store.changes("notes", since).orderBy("version", "id").collect()]
    assert got == [(1, "replaced", "b#0", 1, "b", "new"), (1, "inserted", "c#0", 2, "c", "new"), (2, "deleted", "a#0", 0, "a", None)]
    assert store.changes("notes", store.version("notes")).count() == 0


def test_a_broken_copy_goes_on(spark, store, tmp_path, monkeypatch):
    ids = [f"d{i}#0" for i in range(10)]
    store.upsert("notes", rows(spark, *ids))
    for broken in range(4):
        target, plain, sizes = Store(spark, f"file://{tmp_path}/other{broken}"), Store.upsert, []

        def upsert(self, name, batch, **k):
            if len(sizes) == broken:
                sizes.append(0)
                raise RuntimeError("killed")
            sizes.append(batch.count())
            return plain(self, name, batch, **k)

        with monkeypatch.context() as m:
            m.setattr(Store, "upsert", upsert)
            with pytest.raises(RuntimeError):
                copy_collection(store, target, "notes", batch=3)
            done = copy_collection(store, target, "notes", batch=3, clean=False)
        assert done == {"source": 10, "target": 10, "same_ids": True, "differing": 0}
        assert sizes == [3, 3, 3, 1][:broken] + [0] + [3, 3, 3, 1][broken:]  # no whole batch is read again
    store.upsert("notes", rows(spark, "z#0"))
    assert copy_collection(store, target, "notes", batch=3, clean=False)["target"] == 10  # goes on with the version it began with
    assert copy_collection(store, target, "notes", batch=3)["target"] == 11


def test_changes_as_a_stream(spark, store, tmp_path):
    """A view of the documents' chunks that follows the stream, stopped and started again, is the collection; the keyword index
    follows by the same commits."""
    from quillspark.operators import keyword
    from quillspark.streaming import store_changes

    view, batches = {}, []

    def follow(df, n):
        got = df.orderBy("version", "id").collect()
        batches.append(sorted({r.version for r in got}))
        for r in got:
            view.pop(r.id, None) if r.kind == "deleted" else view.update({r.id: (r.seq, r.title, r.metadata)})

    def run():
        stream = store_changes.read_changes(spark, store.root, "notes").writeStream.foreachBatch(follow)
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(300)

    store.upsert("notes", rows(spark, "a#0", "b#0", "c#0"))
    run()
    assert set(view) == {"a#0", "b#0", "c#0"}
    store.upsert("notes", rows(spark, "b#0", "d#0", title="new"))
    store.delete_document("notes", "a")
    store.compact("notes", whole=True)
    run()
    assert view == {r.id: (r.seq, r.title, r.metadata) for r in store.read("notes").collect()} and batches == [[1], [2, 3]]
    index = keyword.KeywordIndex(store, "notes", f"file://{tmp_path}/index")
    assert not index.backfill()
    store.upsert("notes", rows(spark, "d#0", "e#0"))
    assert index.follow() == store.version("notes") and not index.backfill()
    assert {r.id for r in index.search(["text"]).collect()} == {"b#0", "c#0", "d#0", "e#0"}
