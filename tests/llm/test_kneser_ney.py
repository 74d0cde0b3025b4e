import math
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import kneser_ney as K

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["the cat sat on the mat", "The cat ate\tthe rat.", "a cat", None, "", "  leading and trailing  ", "the cat sat on the mat", "ÄÖ äö É é the", "x " * 300, "the dog\nsat\x0bon the rug and the cat saw the dog run on and on and on"]


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOWER)), "<end>"]


class Brute:
    """The model by its definition, over dictionaries."""

    def __init__(self, texts):
        grams = Counter()
        self.words = Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            grams.update(zip(["<start>", *w], w))
        self.grams, self.after, lefts = grams, defaultdict(list), Counter()
        for (v, w), c in grams.items():
            self.after[v].append(c)
            lefts[w] += 1
        self.lefts = lefts
        self.d2 = self.discounts(grams.values())
        self.d1 = self.discounts(lefts.values())

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        out = [0.0]
        for c, rest in ((1, 0.5), (2, 0.75), (3, 0.9)):
            d = max(0, min(c, c - (c + 1) * y * n[c + 1] / n[c])) if n[c] and c - (c + 1) * y * n[c + 1] / n[c] else None
            out.append(rest if d is None else d)
        return out

    def low(self, w):
        total = sum(self.lefts.values())
        if not total:
            return 1.0
        c = self.lefts[w]
        gamma = sum(self.d1[min(x, 3)] for x in self.lefts.values()) / total
        return (c - self.d1[min(c, 3)]) / total + gamma / (len(self.words) + 1)

    def p(self, v, w):
        if v not in self.after:
            return self.low(w)
        total, c = sum(self.after[v]), self.grams[v, w]
        return (c - self.d2[min(c, 3)]) / total + sum(self.d2[min(x, 3)] for x in self.after[v]) / total * self.low(w)


@pytest.fixture(scope="module")
def trained(spark):
    return K.train(spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").repartition(3)), Brute(TEXTS * 2)


def test_scores_equal_the_definition(spark, trained):
    model, brute = trained
    asked = [*TEXTS, "a wholly unknown sentence", "the unknown cat"]
    got = {r.doc_id: r for r in K.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    n, v = sum(brute.words.values()), len(brute.words)
    assert model.n_tokens == n and model.n_words == v
    for i, text in enumerate(asked):
        w = tokens(text)
        assert got[i].n_tokens == len(w)
        assert got[i].n_known == sum(x in brute.words for x in w)
        assert got[i].base_score == pytest.approx(sum(math.log10((brute.words[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert got[i].score == pytest.approx(sum(math.log10(brute.p(a, b)) for a, b in zip(["<start>", *w], w)), rel=1e-6)


def test_probabilities_sum_to_one(trained):
    _, brute = trained
    for v in ("<start>", "the", "cat", "never seen"):
        assert sum(brute.p(v, w) for w in brute.words) + brute.p(v, "<unknown>") == pytest.approx(1)


def test_empty_training(spark):
    model = K.train(spark.createDataFrame([], "text string"))
    row = K.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)
    assert K.score_documents(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
