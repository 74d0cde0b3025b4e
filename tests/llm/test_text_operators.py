import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, jaccard_join, line_spread, quality, toxicity, url_rules

BENCH = "item_id long, text string"


def test_lines_on_many_sites_go(spark, documents):
    docs = [(i, f"own line {i}\n  shared by five \nshared by four" if i < 4 else f"own line {i}\nshared by five", "en", f"s{i}") for i in range(5)]
    docs += [(7, None, "en", "s0"), (8, "", None, None), (9, "shared by five", "en", None), (0, docs[0][1], "en", "s0")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_spread.remove_boilerplate(documents(docs), min_sites=5).collect()}
    assert got == {(0, "own line 0\nshared by four", 3, 1), (1, "own line 1\nshared by four", 3, 1), (2, "own line 2\nshared by four", 3, 1), (3, "own line 3\nshared by four", 3, 1), (4, "own line 4", 2, 1), (7, "", 0, 0), (8, "", 0, 0), (9, "", 1, 1)}
    assert line_spread.remove_boilerplate(documents(docs), min_sites=5).count() == len(docs)
    assert line_spread.remove_boilerplate(documents([])).count() == 0


def test_listed_and_mined_url_rules(spark):
    urls = [(f"http://spam{i % 3}.example.org/buy/{i}", True) for i in range(30)] + [(f"http://good{i}.example.org/read/{i}", False) for i in range(60)]
    labelled = spark.createDataFrame(urls + [(None, True), ("http://x.org/", None)], "url string, blocked boolean")
    pages = [(1, "http://new.example.org/buy/99"), (2, "http://new.example.org/read/99"), (3, "https://WWW.Example.com/en/x?q"), (4, "http://a.example.com/en/"), (5, "http://a.com"), (6, "http://b.net/es/#"), (7, None), (8, "no scheme"), (None, "http://a.com/")]
    rows = {r.page_id: r for r in url_rules.judge_urls(spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, rule string"), labelled).collect()}
    assert {i: (r.rule, r.verdict) for i, r in rows.items()} == {
        1: (None, "block"), 2: (None, "allow"), 3: ("www.example.com/en/", "allow"), 4: ("example.com/en/", "block"), 5: (None, "allow"),
        6: ("net/es/", "block"), 7: (None, "allow"), 8: (None, "allow"), None: ("com/", "allow"),
    }
    assert (rows[3].host, rows[3].path, rows[7].host, rows[8].path) == ("www.example.com", "/en/x", "", "")
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(nothing, labelled.limit(0)).count() == 0


def brute_rules(labelled, min_support=url_rules.MIN_SUPPORT, min_count=url_rules.MIN_COUNT, min_lift=url_rules.MIN_LIFT):
    """All sets of tokens of (tokens, blocked) rows that pass support and lift, with their confidence."""
    from itertools import combinations

    need = max(min_support * len(labelled), min_count)
    base = sum(b for _, b in labelled) / len(labelled)
    hits = {}
    for tokens, blocked in labelled:
        if blocked:
            for n in range(1, len(tokens) + 1):
                for c in combinations(sorted(tokens), n):
                    hits[c] = hits.get(c, 0) + 1
    hits = {c: n for c, n in hits.items() if n >= need}
    found = {c: n / sum(set(c) <= set(t) for t, _ in labelled) for c, n in hits.items()}
    return {c: x for c, x in found.items() if x >= min_lift * base}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mined_rules_decide_urls(spark, sf):
    """On the test data rules are found, block some URLs that no listed rule fits, and equal mining by brute force."""
    from pyspark.sql import functions as F

    pages, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("pages", "labels"))
    labelled = pages.join(labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality")), "page_id").select("url", (F.col("quality") == 0).alias("blocked"))
    got = url_rules.judge_urls(pages, labelled).collect()
    assert sum(r.mined_confidence is not None for r in got) > 0 and any(r.verdict == "block" and r.rule is None for r in got)
    known = [(tuple(r[0]), r[1]) for r in labelled.where("url is not null and blocked is not null").select(url_rules.url_tokens(F.col("url")), "blocked").collect()]
    rules = brute_rules(known)
    tokens = {r[0]: set(r[1]) for r in pages.select("url", url_rules.url_tokens(F.col("url"))).distinct().collect()}
    for r in got:
        best = max((x for c, x in rules.items() if set(c) <= tokens[r.url]), default=None)
        assert r.mined_confidence == (None if best is None else pytest.approx(best))


QUESTION = "Last week Tom bought 3 apples and 12 pears for 9 dollars while his sister Anna bought 3 plums, so how many fruits did Tom and Anna carry home together?"
CHANGED = "Last week Jim bought 5 apples and 40 pears for 7 dollars while his sister Mia bought 5 plums, so how many fruits did Jim and Mia carry home together?"
BROKEN = "Last week Jim bought 5 apples and 40 pears for 7 dollars while his sister Mia bought 8 plums, so how many fruits did Bob and Mia carry home together?"


def test_reparameterised_questions_are_found(spark, documents):
    bench = spark.createDataFrame([(1, QUESTION), (2, "Short one item"), (3, None), (4, "")], BENCH)
    pad = "some words that come before the question and mean nothing at all. "
    docs = [(1, pad + QUESTION + " " + pad, "en", "s"), (2, pad + CHANGED, "en", "s"), (3, pad + BROKEN, "en", "s"), (4, pad * 5, "en", "s"), (5, None, None, None), (6, "", "en", "s"), (7, "what a short one, item is", "en", "s"), (None, QUESTION.upper() + "", "en", "s"), (1, pad + QUESTION + " " + pad, "en", "s")]
    rows = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(documents(docs), bench).collect()}
    assert {k for k in rows if k[0] is not None} == {(1, 1), (2, 1), (7, 2)}
    assert rows[2, 1].changed > 0 and rows[1, 1].changed == 0 and rows[2, 1].matched <= rows[2, 1]["of"]
    kept = decontamination.drop_leaks(documents(docs), bench)
    assert {3, 4, 5, 6} <= {r.doc_id for r in kept.collect()} and not {1, 2, 7} & {r.doc_id for r in kept.collect()}
    assert kept.columns == documents(docs).columns
    assert decontamination.find_leaks(documents([]), bench).count() == 0
    assert decontamination.find_leaks(documents(docs), bench.limit(0)).count() == 0


PASSAGE = "the river rises in the hills and runs past three old mills before it meets the sea near a small and quiet harbour where boats lie"
OPENERS = "Tom has 5 apples in a basket by the door. Anna gives him 3 more before they leave for the market. Ben takes 2 of them home and eats one on the way."


def test_names_that_open_sentences_and_capitals_are_found(spark, documents):
    bench = spark.createDataFrame([(1, OPENERS), (2, PASSAGE)], BENCH)
    swapped = OPENERS.replace("Tom", "Jim").replace("Anna", "Mia").replace("Ben", "Sam").replace("5", "7")
    pad = "some words that come before the question and mean nothing at all. "
    docs = [(1, pad + swapped, "en", "s"), (2, pad + PASSAGE.upper(), "en", "s"), (3, PASSAGE.title() + " " + pad, "en", "s"), (4, pad * 4, "en", "s"), (5, OPENERS[:60] + pad, "en", "s")]
    rows = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(documents(docs), bench).collect()}
    assert set(rows) == {(1, 1), (2, 2), (3, 2)}
    assert rows[1, 1].matched == rows[1, 1]["of"] and rows[1, 1].changed == 4 and rows[2, 2].matched == rows[2, 2]["of"]
    assert {r.doc_id for r in decontamination.drop_leaks(documents(docs), bench).collect()} == {4, 5}


TRIP = "every morning before sunrise the old driver said that Tom covers 80 km along the coast and rests near the bridge until the fog has gone"
SHORT_ITEM = "the narrow bridge behind our house was built by two brothers from another valley"


def test_slots_of_other_lengths_and_single_words_are_bridged(spark, documents):
    bench = spark.createDataFrame([(1, TRIP), (2, PASSAGE), (3, SHORT_ITEM)], BENCH)
    pad = "some words that come before the question and mean nothing at all. "
    cut = PASSAGE.split()
    docs = [
        TRIP.replace("80 km", "90km"), TRIP.replace("Tom", "Mary Ann"), " ".join([*cut[:14], "often", *cut[14:]]), " ".join([*cut[:13], *cut[14:]]),
        SHORT_ITEM.replace("built", "made"), " ".join(cut[:12]), " ".join([*cut[:10], *pad.split() * 5, *cut[20:]]), f"{PASSAGE}. {PASSAGE}",
    ]
    rows = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(documents([(i, f"{pad} {t} {pad}", "en", "s") for i, t in enumerate(docs)]), bench).collect()}
    assert set(rows) == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (7, 2)}
    assert rows[0, 1].matched == rows[0, 1]["of"] and rows[1, 1].matched == rows[1, 1]["of"] and rows[1, 1].changed == 1
    assert rows[7, 2].matched == rows[7, 2]["of"]


def test_long_runs_of_capitalised_words(spark, documents):
    bench = spark.createDataFrame([(1, TRIP)], BENCH)
    runs = ["Von " * 50_000, "Anna, " * 20_000, "O'Neil\t" * 50_000, "Mary Ann Smith2 " * 10_000]
    docs = documents([(i, r + TRIP + " " + r, "en", "s") for i, r in enumerate(runs)] + [(9, runs[0], "en", "s")])
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} == {0, 1, 2, 3}


def most_generated(spark, run):
    """The largest number of rows that one generator gave in the queries of run()."""
    bus, store = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    listed, most = store.executionsList(), 0
    for e in range(before, store.executionsCount()):
        number = listed.apply(e).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if node.name() == "Generate"):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_items_of_other_lengths_make_no_more_rows(spark, documents, monkeypatch):
    """A token gives one row by kind of template, however many lengths the windows have."""
    items = {n: " ".join(f"item{chr(96 + n)}{chr(97 + i)}" for i in range(n)) for n in (*range(1, 10), 14, 30)}
    bench = spark.createDataFrame(list(items.items()), BENCH)
    pad = "some words that come before the item, and after it. " * 40
    docs = documents([(n, pad + t + " " + pad, "en", "s") for n, t in items.items()] + [(99, pad + items[30][:60] + " " + pad, "en", "s"), (0, "", None, None)])
    found = []
    most = most_generated(spark, lambda: found.extend(decontamination.find_leaks(docs, bench).collect()))
    assert sorted((r.doc_id, r.item_id) for r in found) == [(n, n) for n in sorted(items)]
    assert all(r.matched == r["of"] for r in found)
    tokens = sum(len((r.text or "").split()) for r in docs.collect())
    assert tokens <= most <= 2 * tokens + 2  # an empty text gives a row of nulls
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)  # as with more heads than may be broadcast
    assert set(decontamination.find_leaks(docs, bench).collect()) == set(found)


LOWERED = QUESTION.lower().replace("3", "three").replace("12", "twelve").replace("9", "nine")
COLLAPSED = QUESTION.replace("12", "3").replace("9", "3").replace("Anna", "Tom")


def test_slots_are_consistent_both_ways(spark, documents):
    bench = spark.createDataFrame([(1, QUESTION)], BENCH)
    longer = QUESTION.replace("his sister", "his dear sister")
    docs = [longer, LOWERED, COLLAPSED, QUESTION.replace("Anna", "Tom")]
    rows = {r.doc_id for r in decontamination.find_leaks(documents([(i, t, "en", "s") for i, t in enumerate(docs)]), bench).collect()}
    assert rows == {0, 1}


def test_recall_of_reparameterised_items(spark, documents):
    """Items of random words with numbers and names; copies with other values, a word put in, left out or exchanged."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "me", "ron", "sit"]) for _ in range(rng.randint(2, 3)))
    names = ["Tom", "Anna", "Ben", "Mia", "Jim", "Lea", "Sam", "Eva", "Max", "Ida"]

    def item():
        words = [word() for _ in range(rng.randint(24, 45))]
        for at in rng.sample(range(1, len(words)), 3):
            words[at] = f"{rng.randint(2, 99)}"
        for name, at in zip(rng.sample(names, 2), rng.sample(range(1, len(words)), 2)):
            words[at] = name
        return words

    def change(words, kind):
        new = {w: str(rng.randint(100, 999)) for w in words if w.isdigit()}
        new |= dict(zip([n for n in names if n in words], rng.sample([n for n in names if n not in words], 4)))
        out = [new.get(w, w) for w in words]
        at = rng.randrange(2, len(out) - 2)
        if kind == 1:
            out.insert(at, word())
        elif kind == 2:
            del out[at]
        elif kind == 3:
            out[at] = word()
        return out

    items = [item() for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w) + "?") for i, w in enumerate(items)], BENCH)
    pad = lambda: " ".join(word() for _ in range(40))
    docs = [(4 * i + kind, f"{pad()}. {' '.join(change(w, kind))}? {pad()}", "en", "s") for i, w in enumerate(items) for kind in range(4)] + [(1000 + i, pad() + ". " + pad(), "en", "s") for i in range(60)]
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents(docs), bench).collect()}
    assert all(d // 4 == i for d, i in found)
    for kind in range(4):
        assert sum((4 * i + kind, i) in found for i in range(60)) >= 54, kind


def shingles(text, width=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows):
    sets, root = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(find(i), []).append(r[0])
    return [(r[0], len(sets[i]), min(names[find(i)])) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def near_rows():
    """A large group of near copies, chains, a passage that all share, short and empty texts, copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(20)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = word()
        rows.append(" ".join(w))
    for i in range(60):
        rows.append(" ".join([*(word() for _ in range(rng.randint(4, 40))), *passage, *(word() for _ in range(rng.randint(0, 40)))]))
    chain = [word() for _ in range(60)]
    for i in range(8):
        rows.append(" ".join(chain[i * 3 : i * 3 + 40]))
    rows += ["one two", "ONE  two", "one two three", "", None, "   ", *rows[:10], *rows[125:130]]
    rng.shuffle(rows)
    return [(i, t, "en", "s") for i, t in enumerate(rows)]


def test_join_equals_brute_force(spark, documents, near_rows):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(documents(near_rows).repartition(3)).collect())
    assert got == sorted(brute_components([(i, t) for i, t, *_ in near_rows]))


def test_one_row_of_each_group_stays(spark, documents, near_rows):
    extra = [(None, "one two", "en", "s"), (3, near_rows[3][1], "en", "s")]
    kept = jaccard_join.drop_similar(documents(near_rows + extra))
    names = {c for _, n, c in brute_components([(i, t) for i, t, *_ in near_rows]) if n}
    empty = {i for i, t, *_ in near_rows if not shingles(t)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(names | empty)
    assert kept.columns == documents([]).columns
    assert jaccard_join.drop_similar(documents([])).count() == 0


def shuffled(spark, act):
    """What act() gives, and the bytes that its stages wrote for shuffles."""
    jsc = spark.sparkContext._jsc.sc()

    def written():
        jsc.listenerBus().waitUntilEmpty()
        arrays, lists = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList()
        stages = jsc.statusStore().stageList(lists, False, False, arrays, lists)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    found = act()
    return found, written() - before


@pytest.fixture(scope="module")
def lonely_rows():
    """Texts with a passage that all share, of which ten have a partner."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = [word() for _ in range(7)]
    rows = [[*(word() for _ in range(20)), *passage, *(word() for _ in range(20))] for _ in range(2000)]
    for r in range(0, 20, 2):
        rows[r + 1] = [*rows[r][:-2], "changed", "words"]  # 41 of 45 shingles
    return [(i, " ".join(w), "en", "s") for i, w in enumerate(rows)]


def test_shuffle_stays_small_where_fragments_outnumber_shingles(spark, documents, lonely_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRAGMENT_ENTRIES", 1000)
    got, size = shuffled(spark, lambda: jaccard_join.similar_documents(documents(lonely_rows).coalesce(3)).collect())
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2 if i < 20 else i) for i in range(2000)]
    assert size < 8 * sum(r.n_shingles for r in got)


def test_tasks_of_the_count_hold_a_bounded_share(spark, documents, near_rows, monkeypatch):
    """More pairs and more shingles make more groups, not larger ones, and the result stays the same."""
    monkeypatch.setattr(jaccard_join, "FRAGMENT_ENTRIES", 1000)
    monkeypatch.setattr(jaccard_join, "SLAB_PAIRS", 100)
    monkeypatch.setattr(jaccard_join, "PAIRS", 30)
    monkeypatch.setattr(jaccard_join, "FLUSH", 200)
    monkeypatch.setattr(jaccard_join, "HELD", 50)
    seen, plain = [], jaccard_join.count_overlaps

    def watched(candidates, segments, *rest):
        segments, sizes = segments.cache(), segments.groupBy("fragment").agg(F.sum(F.octet_length("hashes") / 8).alias("n"))
        seen.append((candidates.agg(F.sum(F.octet_length("a") / 8)).first()[0] or 0, sizes.agg(F.max("n")).first()[0] or 0))
        return plain(candidates, segments, *rest)

    monkeypatch.setattr(jaccard_join, "count_overlaps", watched)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(documents(near_rows).repartition(3)).collect())
    assert got == sorted(brute_components([(i, t) for i, t, *_ in near_rows]))
    assert max(n for n, _ in seen) > 300 and all(most <= 1000 for _, most in seen), seen


def test_rows_are_dropped_alike_in_small_slabs(documents, near_rows, monkeypatch):
    for name, value in (("FRAGMENT_ENTRIES", 1000), ("SLAB_PAIRS", 100), ("PAIRS", 30), ("FLUSH", 200), ("HELD", 50)):
        monkeypatch.setattr(jaccard_join, name, value)
    names = {c for _, n, c in brute_components([(i, t) for i, t, *_ in near_rows]) if n}
    empty = {i for i, t, *_ in near_rows if not shingles(t)}
    assert sorted(r.doc_id for r in jaccard_join.drop_similar(documents(near_rows)).collect()) == sorted(names | empty)


def test_dropping_rows_shuffles_no_texts(spark, documents, lonely_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FRAGMENT_ENTRIES", 1000)
    monkeypatch.setattr(jaccard_join.join_small, "__defaults__", ("inner", 5))
    got, size = shuffled(spark, lambda: jaccard_join.drop_similar(documents(lonely_rows).coalesce(3)).collect())
    assert sorted(r.doc_id for r in got) == [i for i in range(2000) if i >= 20 or i % 2 == 0]
    assert size < 8 * 43 * 2000


def test_components_settle(spark):
    from quillspark.llm.components import components

    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 170)]
    got = {(r.node, r.label) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 100), (101, 100), (150, 150), (170, 150), (200, 150)}


def counts(text):
    w = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.split()]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in windows if windows.count(g) > 1}
    hit = {i + k for i, g in enumerate(windows) if g in twice for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark, documents):
    texts = ["a b c a b c a b c d", "x\nx\n\n \nx y", "## a|b <c> $5 & *", None, "", "a a a a a", "one two", "é ü 漢字 \U0001f600", " \t ", "a b c d a b c d " * 20]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(documents([(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_documents_stay(spark, documents):
    rng = random.Random(9)
    clean = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))
    docs = [(i, clean(rng.randint(60, 400)), "en" if i % 3 else "de", f"s{i % 2}") for i in range(400)]
    docs += [(500 + i, " ".join(w + "###$$$" for w in clean(150).split()), "en", "s0") for i in range(30)]
    docs += [(600, "too short", "en", "s0"), (601, None, None, None), (602, clean(20000), "en", "s1"), (603, "a b c " * 100, "en", "s0")]
    rows = {r.doc_id: r for r in quality.judge(documents(docs), min_cell=50).collect()}
    assert all(rows[i].kept for i in range(400)) and rows[602].kept
    assert not any(rows[500 + i].kept or rows[500 + i].base_failed for i in range(30))
    assert all(rows[i].base_failed and not rows[i].kept for i in (600, 601, 603))
    out = quality.keep_sound(documents(docs), min_cell=50)
    assert {r.doc_id for r in out.collect()} == {i for i in rows if rows[i].kept} and out.columns == documents([]).columns
    assert quality.keep_sound(documents([])).count() == 0
    assert all(r.kept and r.d2 is None for r in quality.judge(documents(docs[:5])).collect())


def test_estimates_equal_exact_search(spark, documents):
    """On small cells the estimate has the least determinant of all subsets of the wanted size, floors included."""
    from itertools import combinations

    import numpy as np

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    docs = documents([(100 * c + i, " ".join(word() * (1 + 3 * (i > 12)) for _ in range(rng.randint(55, 300))) + " ###" * (3 * i * (i > 11)), "en", f"s{c}") for c in range(2) for i in range(16)])
    rows = quality.text_counts(docs, ["doc_id", "lang", "source"]).select("*", *quality.vector()).toPandas()
    floors = np.diag((np.array([f for _, f in quality.DIMENSIONS]) * quality.SCALE) ** 2)
    factor = lambda share: share / quality.chi2_cdf(quality.chi2_quantile(share, 5), 7)
    judged = quality.judge(docs, min_cell=10).toPandas().set_index("doc_id")
    for _, cell in rows.groupby("source"):
        x = cell[[f"q{i}" for i in range(5)]].to_numpy(float)
        fit = lambda keep, share: (x[keep].mean(0), factor(share) * np.cov(x[keep].T, bias=True) + floors)
        mean, cov = min((fit(list(k), 0.75) for k in combinations(range(16), 12)), key=lambda e: np.linalg.slogdet(e[1])[1])
        d2 = lambda: ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
        mean, cov = fit(d2() <= quality.chi2_quantile(quality.REWEIGHT, 5), quality.REWEIGHT)
        assert np.allclose(judged.d2.loc[cell.doc_id].to_numpy(), d2(), rtol=1e-6)


def test_kernel_equals_definition():
    from itertools import combinations

    def slow(s, t, n, decay):
        total = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in (("idiot", "i.d.i.o.t"), ("science", "ensinec"), ("aaaa", "aaa"), ("ab", "abcd")):
        got = float(toxicity.subsequence_kernel(toxicity.codes([s], 12), t, 3, 0.7)[0])
        assert got == pytest.approx(slow(s, t, 3, 0.7), rel=1e-5)


def test_toxic_documents(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "er", "on", "an", "re", "ing", "st"]) for _ in range(rng.randint(1, 4)))
    plain = lambda: " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(20)) + "."
    insults = ["imbecile", "blockhead", "dimwit", "oaf"]
    toxic = lambda: plain() + f" you {rng.choice(insults)} {word()}. " + plain()
    texts = [plain() + f" you {word()}." for _ in range(150)] + [toxic() for _ in range(60)]
    model = toxicity.train(texts, [0] * 150 + [1] * 60)
    asked = [plain() for _ in range(40)] + [toxic() for _ in range(40)] + [plain() + " what a b.l.o.c.k.h.e.a.d here", plain() + " d i m w i t ", plain() + " imbeciile", None, "", "x" * 5000, plain() * 300 + " oaf!"]
    rows = {r.doc_id: r.score for r in toxicity.score_documents(documents([(i, t, None, None) for i, t in enumerate(asked)]), model).collect()}
    assert len(rows) == len(asked) and all(0 <= s <= 1 for s in rows.values())
    assert sum(rows[i] >= 0.5 for i in range(40)) <= 1 and sum(rows[i] >= 0.5 for i in range(40, 80)) >= 39
    assert rows[80] >= 0.5 and rows[81] >= 0.5 and rows[82] >= 0.5
    assert rows[83] == rows[84] < 0.5 and rows[86] >= 0.5
    assert toxicity.score_documents(documents([]), model).count() == 0
    one = toxicity.train(["a"], [1])
    assert toxicity.score_documents(documents([(1, "x", None, None)]), one).first().score == 1.0
    assert toxicity.train([], []).value == 0.0


def test_landmarks_stand_for_stems():
    """Each kind of insult is found though no form of it is frequent; copies of one toxic text make no landmarks."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "me", "ron", "sit"]) for _ in range(rng.randint(2, 4)))
    plain = lambda: " ".join(word() for _ in range(60))
    form = lambda stem: stem + "".join(rng.choice("aeiou") for _ in range(2))
    texts = [plain() for _ in range(200)] + [plain() + " " + form(rng.choice(["gruft", "wezzl"])) + " " + plain() for _ in range(60)]
    model = toxicity.train(texts, [0] * 200 + [1] * 60)
    assert any("gruft" in t for t in model.landmarks) and any("wezzl" in t for t in model.landmarks)
    import pyarrow as pa

    found = toxicity.score_texts(model, pa.array([f"{plain()} {form(s)} {plain()}" for s in ["gruft", "wezzl"] * 20] + [plain() for _ in range(40)]))
    assert (found[:40] >= 0.5).sum() >= 38 and (found[40:] >= 0.5).sum() <= 1


def test_recall_by_language(spark):
    """Held out labelled rows of the test data, language by language; a few toxic labels there stand on texts without any insult."""
    import zlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas().groupby("doc_id").toxic.max()
    docs = docs[docs.doc_id.isin(labels.index)].assign(toxic=lambda d: d.doc_id.map(labels), held=lambda d: [zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id])
    fit = docs[~docs.held].groupby("toxic").head(toxicity.TRAIN_DOCS)
    model = toxicity.train([t or "" for t in fit.text], fit.toxic.astype(int).tolist())
    held = docs[docs.held]
    held = held.assign(found=toxicity.score_texts(model, pa.array(held.text)) >= 0.5)
    recall = held[held.toxic == 1].groupby("lang").found.mean()
    assert recall.min() >= 0.85 and held[held.toxic == 1].found.mean() >= 0.9
    assert held[held.toxic == 0].found.mean() <= 0.06
