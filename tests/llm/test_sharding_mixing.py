import random
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import pytest

from quillspark.llm import mixing, sharding

LABELS = "doc_id long, quality int, toxic int"


def minimax(sizes, shards):
    """Smallest capacity for contiguous parts of sizes, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] * (len(sizes) + 1)
        for j in range(1, len(sizes) + 1):
            new[j] = min(max(best[i], sum(sizes[i:j])) for i in range(j))
        best = new
    return best[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_capacity_is_the_smallest(spark, documents, seed):
    rng = random.Random(seed)
    texts = [rng.choice(["a", "b", "ccc"]) * rng.randint(0, 40) for _ in range(60)] + [None, "", "hot" * 30] + ["hot" * 30] * 20
    rows = sharding.shard_documents(documents([(i, t, "en", "s") for i, t in enumerate(texts)]), 5).collect()
    assert len(rows) == len(texts)
    groups = Counter()
    for t in texts:
        groups[md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    assert {r.capacity for r in rows} == {minimax([groups[k] for k in sorted(groups)], 5)}
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, crc32(t.encode()))
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert max(load.values()) <= rows[0].capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_sharding_edges(spark, documents):
    assert sharding.shard_documents(documents([])).count() == 0
    rows = sharding.shard_documents(documents([(None, None, None, None), (None, "x", None, None), (1, "x", "en", "s"), (1, "x", "en", "s")])).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r["size"] == 2}) == 1


def level(sizes, weights, most=3.0):
    """Water filling as described: capped sources leave, the others share the rest by weight."""
    rest, left, targets = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] > most * sizes[i]}
        if not over:
            for i in left:
                targets[i] = share[i]
            break
        for i in over:
            targets[i] = most * sizes[i]
            rest -= targets[i]
        left -= over
    return targets


def test_mix_meets_targets(spark, documents):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["b", "a", "c", None, "d"])) for i in range(400)] + [(1000, None, "en", "a"), (1001, "one", "en", "tiny"), (5, "repeated id", "en", "b"), (5, "repeated id", "en", "b")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], LABELS)
    rows = mixing.mix(documents(docs), labels).collect()
    assert len(rows) == len(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.times * r["size"] <= 3 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    wanted = level([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, t in zip(names, wanted):
        assert target[name] == pytest.approx(t)
        assert abs(taken[name] - t) <= 15
    for name in names:
        times = {r.times for r in rows if r.source == name}
        assert max(times) - min(times) <= 1
    again = mixing.mix(documents(docs).repartition(7), labels).collect()
    key = lambda r: (str(r.doc_id), r.text_hash, str(r.source), r.times)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_repeat_rows_keeps_columns(spark, documents):
    docs = documents([(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (2, "d", None, None), (None, "e f", "en", "x")])
    labels = spark.createDataFrame([], LABELS)
    times = sum(r.times for r in mixing.mix(docs, labels).collect())
    out = mixing.repeat_rows(docs, labels)
    assert out.columns == docs.columns and out.count() == times
    assert mixing.repeat_rows(documents([]), labels).count() == 0
