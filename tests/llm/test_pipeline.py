"""The pipeline on a small corpus against brute-force versions of its stages."""

import random
from collections import Counter
from hashlib import md5

import pytest
from test_sharding_mixing import level, minimax
from test_text_operators import brute_components, counts

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = "which of the following numbers comes next after the last one in this row of the table"
    rows = [(i, text(rng.randint(55, 120)), "en", rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(50, text(20), "en", "a"), (51, None, None, None), (52, "a b c " * 40, "en", "a"), (53, text(60) + " " + item + " " + text(10), "en", "b"), (54, rows[3][1], "en", "b"), (55, rows[4][1] + " more", "en", "a"), (56, rows[5][1], "en", "b"), (None, rows[6][1], "en", "a"), (7, rows[7][1], "en", rows[7][3])]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, s, 1, "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_stages_in_turn(spark, corpus):
    folder, rows, item = corpus
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{i}"
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    sound = [r for r in rows if counts(r[1])[0] >= 50 and 2 * counts(r[1])[4] <= counts(r[1])[0]]
    key = lambda r: (str(r[0]), r[1])
    got = lambda name: sorted((str(r.doc_id), r.text) for r in out[name].collect())
    assert got("quality rules") == sorted(map(key, sound))
    named = [(10**6 if r[0] is None else r[0], r[1]) for r in sound]
    wanted = {c for _, _, c in brute_components(named)}
    kept = got("n-gram Jaccard join")
    assert [i for i, _ in kept] == sorted(map(str, wanted))
    clean = [k for k in kept if item not in k[1]]
    assert got("benchmark decontamination") == clean and len(clean) == len(kept) - 1
    source = {str(r[0]): r[3] for r in rows}
    size, taken = Counter(), Counter()
    for i, t in clean:
        size[source[i]] += len(t.split())
    mixed = got("mixing sources")
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    for i, t in mixed:
        taken[source[i]] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for name, target in zip(names, level([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(taken[name] - target) <= 61
    groups, load = Counter(), Counter()
    for _, t in mixed:
        groups[md5(t.encode()).hexdigest()] += len(t) + 1
    for r in out["sharding"].collect():
        load[r.shard] += r["size"]
    assert sum(load.values()) == sum(groups.values()) and max(load.values()) <= minimax([groups[k] for k in sorted(groups)], 8)


def test_empty_corpus(spark, corpus, tmp_path):
    folder = corpus[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
