"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

A unit is a word without ASCII punctuation, or a run of single characters set apart ("i d i o t"), between two marks for
its ends, so that short words count too. The kernel of two units sums their common subsequences of ORDER characters, each
gap damped by DECAY, and is squared; so an insult with gaps or inserted characters stays close to its plain form. A
sentence is as toxic as its worst unit, a document as its worst sentence. As the machine is linear in the Nyström features,
a unit's decision is one number.

Landmarks are pieces of units, so that one stands for all words of a stem. They are chosen in turn by how strongly they
tell the classes apart; a document counts less for each landmark it already holds, which gives every kind of insult, in
whatever language, its turn, and leaves little weight to words that copies of one toxic document repeat.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, utf8
from quillspark.llm.tokens import mix, runs

ORDER, DECAY = 4, 0.75
#: Marks of a unit's ends.
OPEN, CLOSE = "\x02", "\x03"
#: Units longer than this are seen through windows that overlap by half.
WINDOW = 32
#: Bound of the training sample: so many labelled documents a class, by hash of their id.
TRAIN_DOCS = 1000
#: Characters of a piece that may be a landmark, end marks included.
PIECES = range(4, 13)
#: Bounds of the model: landmarks of either class.
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 40, 16
#: A landmark stands for units that are so like it.
ALIKE = 0.5
#: What is left of a document's weight for each landmark that it holds.
FADE = 0.6
RIDGE = 0.05
#: Log odds times the root of the weighted count that make a piece a toxic landmark.
MIN_STRENGTH = 7.0
#: Choice ends at a piece with less than this share of the strength of the first.
LEAST_SHARE = 0.12
ROUNDS = 8
#: Entries of a worker's cache of word scores; it starts anew beyond that.
CACHE = 1_000_000
#: Bytes of text, about, that a worker splits into words at a time.
SLICE_BYTES = 4 << 20
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
BREAK = "\x00"
DROP = str.maketrans("", "", MARKS + BREAK + OPEN + CLOSE)


def codes(units: list[str], width: int) -> np.ndarray:
    """Code points, one row a unit, padded with -1."""
    out = np.full((len(units), width), -1, np.int32)
    for i, u in enumerate(units):
        out[i, : len(u)] = np.frombuffer(u.encode("utf-32-le"), np.int32)
    return out


def subsequence_kernel(rows: np.ndarray, other: str, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of code points with other: the sum over common subsequences of order characters of decay to
    the power of the lengths they span in both. Dynamic programming over characters, all rows at once."""
    t = np.frombuffer(other.encode("utf-32-le"), np.int32)
    n, m = len(rows), len(t)
    step = np.tril(decay ** np.maximum(0, np.subtract.outer(np.arange(m), np.arange(m))).astype(np.float32)).astype(np.float32)
    prefix = [np.ones((m + 1, n), np.float32)] + [np.zeros((m + 1, n), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for a in range(rows.shape[1]):
        same = (rows[:, a] == t[:, None]).astype(np.float32) * np.float32(decay * decay)
        total += (same * prefix[order - 1][:-1]).sum(0)
        for i in range(order - 1, 0, -1):
            prefix[i][1:] = np.float32(decay) * prefix[i][1:] + step @ (same * prefix[i - 1][:-1])
    return total


def pieces(unit: str) -> list[str]:
    return [unit] if len(unit) <= WINDOW else [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def kernels(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each unit with each landmark. Pairs that can't share ORDER characters are 0 without being computed."""
    out = np.zeros((len(units), len(landmarks)), np.float32)
    by_width: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        by_width.setdefault(-(-len(u) // 4) * 4, []).append(i)
    for width, members in by_width.items():
        for lo in range(0, len(members), 8192):
            at = np.array(members[lo : lo + 8192])
            rows = codes([units[i] for i in at], width)
            present = {c: (rows == c).any(1) for c in {ord(c) for t in landmarks for c in t}}
            for j, t in enumerate(landmarks):
                some = np.flatnonzero(sum(present[ord(c)].astype(np.int8) for c in t) >= ORDER)
                if len(some):
                    out[at[some], j] = subsequence_kernel(rows[some], t)
    return out


def similarities(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Squared kernel with each landmark, scaled to 1 for the landmark itself."""
    own = np.array([float(subsequence_kernel(codes([t], len(t)), t)[0]) for t in landmarks])
    return (kernels(units, landmarks) / own) ** 2


def unit_features(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Similarities with the landmarks; of a long unit the most that any of its windows has."""
    parts = [(i, p) for i, u in enumerate(units) for p in pieces(u)]
    found = similarities([p for _, p in parts], landmarks)
    if len(parts) == len(units):
        return found
    return np.maximum.reduceat(found, runs(np.array([i for i, _ in parts])), axis=0)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def unit_scores(self, units: list[str]) -> np.ndarray:
        return unit_features(units, self.landmarks) @ self.weights

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * decision + self.shift, -500, 500)))


@dataclass
class Constant:
    """Without labels of both classes: the share of toxic ones, 0 without any."""

    value: float


def unit_of(word: str) -> str:
    """A word as the kernel sees it; empty if it is punctuation."""
    return f"{OPEN}{bare}{CLOSE}" if (bare := word.translate(DROP)) else ""


def tokenize(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, ends of lines among them; the word of each token; tokens of each text."""
    marked = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", f" {BREAK} ")
    lists = pc.ascii_split_whitespace(marked)
    encoded = lists.flatten().dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def ends_sentence(word: str) -> bool:
    return word == BREAK or word[-1:] in ".!?"


def spaced_units(words: list[str], single: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> list[tuple[int, str]]:
    """(position of the last token, joined unit) of runs of at least ORDER single characters inside one text."""
    at = np.flatnonzero(single[tokens]) if len(tokens) else np.empty(0, int)
    if len(at) < ORDER:
        return []
    new = np.flatnonzero((np.diff(at) > 1) | np.isin(at[1:], starts)) + 1
    return [(int(run[-1]), "".join(words[tokens[i]] for i in run)) for run in np.split(at, new) if len(run) >= ORDER]


def sentence_bounds(ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence number of each token, and the text of each sentence."""
    first = np.zeros(len(ends) + 1, np.int64)
    first[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = 1
    first[1:][ends] = 1
    sentence = np.cumsum(first[:-1]) - 1
    text = np.repeat(np.arange(len(lengths)), lengths)
    return sentence, text[np.flatnonzero(first[:-1])] if len(ends) else np.empty(0, int)


def _grams(units: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, unit, place) of the distinct pieces of so many characters of each unit."""
    whole = [(i, p, at) for i, u in enumerate(units) for at, p in zip(range(0, max(1, len(u)), WINDOW // 2), pieces(u)) if len(p) >= width]
    if not whole:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = codes([p for _, p, _ in whole], WINDOW).astype(np.int64).view(np.uint64)
    h = np.full((len(whole), WINDOW - width + 1), width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(3) + rows[:, i : i + h.shape[1]])
    row, at = np.nonzero(np.arange(h.shape[1]) <= np.array([len(p) - width for _, p, _ in whole])[:, None])
    h, unit, place = h[row, at], np.array([i for i, _, _ in whole])[row], np.array([a for _, _, a in whole])[row] + at
    order = np.lexsort((h, unit))
    h, unit, place = h[order], unit[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
    return h[new], unit[new], place[new]


def _holders(h: np.ndarray, unit: np.ndarray, first: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, entry) of the pieces and the documents that hold them, by hash and document; docs lists the documents
    of unit u from first[u] on, n[u] of them."""
    many = n[unit]
    entry = np.repeat(np.arange(len(h)), many)
    d = docs[np.repeat(first[unit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    order = np.lexsort((d, h[entry]))
    entry = entry[order]
    return h[entry], d[order], entry


def toxic_landmarks(units: list[str], pairs: np.ndarray, y: np.ndarray, most: int = TOXIC_LANDMARKS) -> tuple[list[str], list[float]]:
    """Pieces of units that tell toxic documents apart, at most so many, and their strengths. pairs: (document, unit) of
    the units that a document holds. All pieces of all units are counted. Units that a landmark already stands for no
    longer count for others; of equally strong pieces the longest is taken."""
    toxic = y[pairs[0]] > 0

    def index(side):
        order = np.argsort(pairs[1][side], kind="stable")
        n = np.bincount(pairs[1][side], minlength=len(units))
        return np.cumsum(n) - n, n, pairs[0][side][order]

    bad, good = index(toxic), index(~toxic)
    total, rest = y.sum() + 0.2, len(y) - y.sum() + 0.2
    names, odds, held = [], [], []
    for width in PIECES:
        h, unit, place = _grams(units, width)
        hh, d, entry = _holders(h, unit, *bad)
        if not len(hh):
            continue
        starts = runs(hh)
        fresh = np.ones(len(hh), bool)
        fresh[1:] = (hh[1:] != hh[:-1]) | (d[1:] != d[:-1])
        df = np.add.reduceat(fresh, starts)
        # No piece is stronger than if no plain document held it.
        able = np.flatnonzero(np.sqrt(df) * (np.log((df + 0.1) / total) - np.log(0.1 / rest)) >= MIN_STRENGTH)
        asked = hh[starts[able]]
        among = np.isin(h, asked)
        gh, gd, _ = _holders(h[among], unit[among], *good)
        once = np.ones(len(gh), bool)
        once[1:] = (gh[1:] != gh[:-1]) | (gd[1:] != gd[:-1])
        gh = gh[once]
        plain = np.searchsorted(gh, asked, side="right") - np.searchsorted(gh, asked)
        log_odds = np.log((df[able] + 0.1) / total) - np.log((plain + 0.1) / rest)
        strong = (log_odds > 1) & (np.sqrt(df[able]) * log_odds >= MIN_STRENGTH)
        ends = np.append(starts, len(hh))
        for k, o in zip(able[strong], log_odds[strong]):
            lo, hi = starts[k], ends[k + 1]
            held.append((np.full(hi - lo, len(names)), d[lo:hi], unit[entry[lo:hi]]))
            e = entry[lo]
            names.append(units[unit[e]][place[e] : place[e] + width])
            odds.append(o)
    if not names:
        return [], []
    owner, docs, of = (np.concatenate(x) for x in zip(*held))
    groups = runs(owner * len(y) + docs)
    owner, docs, odds = owner[groups], docs[groups], np.array(odds)
    length, weight, active = np.array([len(x) for x in names]), np.ones(len(y)), np.ones(len(units), bool)
    rank = np.argsort(np.argsort(np.array(names)))
    some = np.unique(of)
    some_units = [units[i] for i in some]
    found, strengths = [], []
    while len(found) < most:
        alive = np.logical_or.reduceat(active[of], groups)
        strength = odds * np.sqrt(np.bincount(owner[alive], weight[docs[alive]], len(names)))
        if strength.max() < max(MIN_STRENGTH, LEAST_SHARE * max(strengths, default=0)):
            break
        best = max(np.flatnonzero(strength >= strength.max() - 1e-9), key=lambda i: (length[i], -rank[i]))
        found.append(names[best])
        strengths.append(float(strength[best]))
        weight[docs[(owner == best) & alive]] *= FADE
        active[some[unit_features(some_units, [names[best]])[:, 0] >= ALIKE]] = False
    return found, strengths


def plain_landmarks(units: list[str], pairs: np.ndarray, y: np.ndarray, landmarks: list[str], most: int = PLAIN_LANDMARKS) -> list[str]:
    """Units of two plain documents or more, more frequent there, that are most like the toxic landmarks, so that what they share with
    them can be weighed down."""
    plain = np.bincount(pairs[1], y[pairs[0]] == 0, len(units))
    toxic = np.bincount(pairs[1], y[pairs[0]] > 0, len(units))
    some = sorted(units[i] for i in np.flatnonzero((plain >= 2) & (plain * y.sum() > toxic * (len(y) - y.sum()))) if ORDER <= len(units[i]) <= WINDOW)
    near = similarities(some, landmarks).max(1) if some else np.empty(0)
    found: list[str] = []
    while len(found) < most and len(near) and near.max() > 0:
        found.append(some[int(near.argmax())])
        near = np.where(similarities(some, found[-1:])[:, 0] < ALIKE, near, 0)
        near[some.index(found[-1])] = 0
    return found


def train(texts: list[str], toxic: list[int]) -> Model | Constant:
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.0)
    words, tokens, lengths = tokenize(pa.array(texts, pa.string()))
    document = np.repeat(np.arange(len(texts)), lengths)
    type_ends = np.array([ends_sentence(w) for w in words], bool)
    named: dict[str, int] = {}
    unit_at = np.array([named.setdefault(unit_of(w), len(named)) for w in words], np.int64)
    units = list(named)
    tokens, ends = unit_at[tokens], type_ends[tokens]
    pairs = np.unique(np.stack([document, tokens]), axis=1) if len(tokens) else np.empty((2, 0), np.int64)
    landmarks, hints = toxic_landmarks(units, pairs, y)
    if not landmarks:
        # Nothing tells the classes apart: the machine has no feature but its bias.
        return Model([], np.empty(0), 0.0, *platt(np.zeros(len(y)), y))
    landmarks = list(dict.fromkeys(landmarks + plain_landmarks(units, pairs, y, landmarks)))
    # Nyström features of the units.
    own = np.sqrt(np.diag(kernels(landmarks, landmarks)).astype(float))
    values, vectors = np.linalg.eigh((kernels(landmarks, landmarks) / own[:, None] / own) ** 2 + 1e-6 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = unit_features(units, landmarks)
    alike = np.minimum(features[:, : len(hints)], 1)
    hint, alike = (alike * np.array(hints)).max(1), alike.max(1)
    features = features @ whiten.astype(np.float32)
    sentence, owner = sentence_bounds(ends, lengths)
    first = runs(sentence)
    plain = y[owner] == 0
    decision, w, b = hint, np.zeros(features.shape[1]), 0.0
    by_document = runs(owner)
    # A toxic document with nothing like a landmark does not say which of its words are toxic.
    telling = np.maximum.reduceat(np.maximum.reduceat(alike[tokens], first), by_document) >= ALIKE
    telling &= ~plain[by_document]
    for _ in range(ROUNDS):
        # Its worst unit stands for a sentence, its worst sentence for a toxic document; every sentence of a plain one counts.
        order = np.argsort(decision, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        worst = np.maximum.reduceat(rank[tokens], first)
        positive = np.maximum.reduceat(worst, by_document)[telling]
        chosen = order[np.concatenate([positive, worst[plain]])]
        signs = np.concatenate([np.ones(len(positive)), -np.ones(int(plain.sum()))])
        w, b = squared_hinge(features[chosen], signs)
        decision = features @ w
    worst = np.full(len(y), b)
    np.maximum.at(worst, document, decision[tokens] + b)
    scale, shift = platt(worst, y)
    return Model(landmarks, whiten @ w, float(b), scale, shift)


def squared_hinge(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes of equal weight, by Newton steps on the active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    v = np.zeros(z.shape[1])
    for _ in range(30):
        on = y * (z @ v) < 1
        h = (z[on] * cost[on, None]).T @ z[on] + np.diag(penalty)
        new = np.linalg.solve(h, (z[on] * cost[on, None]).T @ y[on])
        if np.abs(new - v).max() < 1e-9:
            break
        v = new
    return v[:-1], float(v[-1])


def platt(decision: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through the decisions, with smoothed targets; both classes weigh the same."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 1 / n1, 1 / n0) * len(y) / 2
    z = np.stack([decision, np.ones(len(y))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (p - target)) + 1e-3 * v)
        v = v - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


class Words:
    """What a worker knows of the words it has met: their decision, and whether they are single characters."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.share, self.single = np.empty(0), np.empty(0, bool)

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.at) > CACHE:
            self.__init__(self.model)
        if new := [w for w in words if w not in self.at]:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            units = [unit_of(w) for w in new]
            self.share = np.append(self.share, self.model.unit_scores(units))
            self.single = np.append(self.single, [len(u) == 3 for u in units])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


_KNOWN: dict[str, Words] = {}


def score_texts(model: Model | Constant, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic; null and empty texts get that of a text none of whose units counts."""
    if isinstance(model, Constant):
        return np.full(len(texts), model.value)
    if model.name not in _KNOWN:  # a worker keeps the words of one model from task to task
        _KNOWN.clear()
        _KNOWN[model.name] = Words(model)
    known = _KNOWN[model.name]
    words, tokens, lengths = tokenize(texts)
    at = known.places(words)
    share, single = known.share[at], known.single[at]
    share = share[tokens] if len(tokens) else np.empty(0)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    if joined := spaced_units(words, single, tokens, starts):
        np.add.at(share, [i for i, _ in joined], model.unit_scores([unit_of(u) for _, u in joined]))
    worst = np.full(len(texts), model.bias)
    if len(tokens):
        np.maximum.at(worst, np.repeat(np.arange(len(texts)), lengths), share + model.bias)
    return model.probability(worst)


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most train_docs documents a class, those whose ids have the smallest hashes; repeated rows
    count once. labels: doc_id, toxic, one row a document. Labels other than 0 and 1 and null ids are left out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(known, "doc_id").distinct()
    chosen = [keys.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(train_docs) for c in (0, 1)]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "toxic-sample")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), ["doc_id", "text_hash"])
    rows = rows.dropDuplicates(["doc_id", "text_hash"]).orderBy("doc_id", "text_hash").collect()
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def score_documents(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """doc_id, score for every row of docs. Null and empty texts score like a text without words. Equal texts score the
    same, whatever their row, and ties are left as they are; very long texts and words are read whole. An empty table
    gives no rows. Other columns are not read."""

    def score(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(model, part.column("text")))], ["doc_id", "score"])
                lo = hi

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, score double")


def single_labels(labels: DataFrame) -> DataFrame:
    """One label a document: toxic if any of its rows says so."""
    return labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sentences(text: str) -> list[str]:
    """The sentences of a text as the model sees them."""
    return [s for s in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n", text) if s.strip()]
