"""The Merkle manifest and the source audit against plain versions, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, merkle

NAMES = "doc_id long, source string, lang string, n_chars long, text string, size long, digest string, idx long, tree long, n long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """(root, proof of each leaf as (left, right) pairs)."""
    proofs, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(i, min(i + fanout, len(level))) for i in range(0, len(level), fanout)]
        for run in runs:
            for at in run:
                pair = ("".join(level[j] for j in run if j < at), "".join(level[j] for j in run if j > at))
                for leaf in owners[at]:
                    proofs[leaf].append(pair)
        owners = [[x for j in run for x in owners[j]] for run in runs]
        level = [h("".join(level[j] for j in run)) for run in runs]
    return level[0], proofs


def plain_manifest(rows, fanout):
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(cell(v) for v in (r[0], r[1], r[2], r[3], text)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, kept = [], [], []
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subroot, proofs = plain_tree([leaf(r, r[4]) for r in ordered], fanout)
        subroots.append(subroot)
        kept.append((ordered, proofs))
    if not rows:
        return []
    root, upper = plain_tree(subroots, fanout)
    for (ordered, proofs), subroot, top in zip(kept, subroots, upper):
        for r, p in zip(ordered, proofs):
            proof, text = p + top, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            folded = leaf(r, text)
            for left, right in proof:
                folded = h(left + folded + right)
            out.append((r[0], leaf(r, r[4]), subroot, root, h("".join(a + b for a, b in proof)), folded, folded == root))
    return out


def manifest_of(spark, rows, fanout):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], NAMES)
    return sorted(map(tuple, merkle.verify(merkle.manifest(docs, merkle.fold_case(docs), fanout)).collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", "Plain Text", "ünÍ " * rng.randrange(4), "lower", "A" * rng.randrange(3)])
    rows = [(i, rng.choice(["a", "b", "", None, "ß", "\U0001f600", "alone"][:6]), rng.choice(["en", None, ""]), rng.choice([None, 0, -5, 7]), text()) for i in range(60)]
    rows += [(None, "a", None, None, None), (None, None, "en", 1, "Null Id"), (7, "a", "en", 1, "twice"), (7, "a", "en", 1, "twice"), (7, "a", "en", 2, "twice"), (100, "alone", "en", 1, "B" * 300_000), (5, "zz", "de", 3, "QQ"), (-4, "zz", "de", 3, "QQ")]
    got = manifest_of(spark, rows, 3)
    assert got == sorted(plain_manifest(rows, 3), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_trees(spark, n):
    """No rows, a root that is a leaf, a full run, and a last run of one."""
    rows = [(i, "only", "en", i, f"Text {i}") for i in range(n)]
    got = manifest_of(spark, rows, 16)
    assert got == sorted(plain_manifest(rows, 16), key=repr)
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")


def test_a_proof_stands_alone(spark):
    """The root follows from a leaf and its siblings; another order or leaf gives another root."""
    docs = spark.createDataFrame([(i, f"s{i % 5}", "en", i, f"t{i}", 0, "", 0, 0, 0) for i in range(40)], NAMES)
    for r in merkle.manifest(docs, fanout=4).collect():
        node = r["leaf"]
        for s in r["proof"]:
            node = h(s["left"] + node + s["right"])
        assert node == r["root"] and r["tampered_leaf"] is None
        assert spark.range(1).select(merkle.fold(F.lit("0" * 64), F.array(*[F.struct(F.lit(s["left"]).alias("left"), F.lit(s["right"]).alias("right")) for s in r["proof"]]))).first()[0] != r["root"] if r["doc_id"] == 3 else True


def plain_audit(rows, min_docs, top):
    groups, counts, in_docs = set(), {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        counts.setdefault((lang, source), Counter()).update(found)
        in_docs.setdefault(lang, Counter()).update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in in_docs.items()}
    p = lambda n, total, v: 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)
    share, whole = {}, {}
    for lang, source in groups:
        c, terms = counts[lang, source], kept.get(lang, [])
        total = sum(c[t] for t in terms)
        share[lang, source] = {t: p(c[t], total, len(terms)) for t in terms}
        every = sum((counts[g] for g in groups if g[0] == lang), Counter())
        whole[lang] = {t: p(every[t], sum(every[x] for x in terms), len(terms)) for t in terms}
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    out = []
    for lang, source in groups:
        mine = share[lang, source]
        pairs = [(o, sum(f(mine[t], share[lang, o][t]) for t in mine)) for g, o in groups if g == lang and o != source]
        terms = [(t, f(mine[t], whole[lang][t])) for t in mine if counts[lang, source][t] > 0 and mine[t] > whole[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def test_audit_of_odd_rows(spark, documents):
    rng = random.Random(9)
    words = ["The", "the", "ÉCOLE", "école", "a1b", "x-y", "straße", "日本語", "😀", "Z", "z", "İ", "it's", "\x00nul"]
    rows = [(i, rng.choice([None, "", *[" ".join(rng.choice(words[: 3 + i % 12]) for _ in range(rng.randrange(20)))] * 6]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ä", None, "", "\U0001f600"])) for i in range(80)]
    rows += [rows[5]] * 3 + [(900, "lonely", "xx", "a"), (901, None, "xx", "b"), (902, "the " * 100_000, "en", "a")]
    docs = documents(rows).withColumnRenamed("size", "term").withColumn("value", F.lit("clash"))
    got = sorted(map(tuple, divergence.audit(docs, 4, 3).collect()))
    assert got == plain_audit(rows, 4, 3)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in got)
    assert divergence.audit(documents([])).count() == 0


def test_proportions_are_exact_beyond_a_long(spark):
    """A term that occurs ten billion times and more."""
    counts = [(9_300_000_000, 10_000_000_000, 7), (10**13, 3 * 10**13 + 1, 10**6), (0, 0, 1)]
    rows = spark.createDataFrame(counts, "n long, total long, terms long")
    got = [r[0] for r in rows.select(divergence.proportion(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in counts]
