"""Interpolated modified Kneser-Ney model: counted in Spark, stored as sorted hash arrays, mapped by the workers.

Grams are counted inside each task and meet in buckets by the hash of their context; the buckets follow the size of the
texts. A context that would fill a good part of a bucket is dealt over all buckets by the word that follows; such contexts
are found by a first pass that keeps what is frequent in a task. A bucket becomes two pairs of files in the shared folder:
sorted gram hashes with counts, and sorted context hashes with their totals and numbers of followers seen once, twice and
more often; a dealt context has a part in each bucket, and its parts are summed. What a bucket holds of a word's left
contexts is summed in a second exchange and becomes the word files. Scoring maps the files and looks hashes up by binary
search; nothing of the model passes through the driver but rows of sums and the few dealt contexts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_path, fresh_path, materialize, utf8
from quillspark.llm.shared_files import mapped, size_of, write_bytes
from quillspark.llm.tokens import batch, joined, mix, word_hashes

#: Hashes of the marks before and behind a text; no word contains a space.
START, END = (int(x) for x in pd.util.hash_array(np.array(["start of text", "end of text"], object), categorize=False))
#: Tokens that a task counts before it passes its grams on, and that it scores at a time.
FLUSH = 1_500_000
#: Bytes of text, about, whose grams make a bucket, and the share of a bucket that makes a context frequent.
BUCKET_BYTES, FREQUENT = 8 << 20, 0.125

GRAM_ROWS = "bucket int, contexts binary, runs binary, words binary, counts binary"
WORD_ROWS = "bucket int, words binary, lefts binary, counts binary, n1 long, n2 long, n3 long, n4 long, grams long, tokens long, known int"
WORD_STATS = "bucket int, n1 long, n2 long, n3 long, n4 long, words long, known int"


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words followed by END, and the number of tokens of each text."""
    words, offsets = word_hashes(texts)
    return np.insert(words, offsets[1:], np.uint64(END)), np.diff(offsets) + 1


def contexts_of(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each token, START for the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = START
    return out


def gram_hash(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(contexts + mix(words + np.uint64(0x9E3779B97F4A7C15)))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, the place of one row of each, and the sums of values."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0) if len(keys) else np.empty(0, int)
    return keys[order[first]], order[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def gram_bucket(contexts: np.ndarray, words: np.ndarray, bits: int, dealt: np.ndarray) -> np.ndarray:
    """Buckets of grams: by context, those of dealt contexts (sorted) by the gram."""
    out = bucket_of(contexts, bits)
    if len(dealt):
        at = np.minimum(np.searchsorted(dealt, contexts), len(dealt) - 1)
        many = dealt[at] == contexts
        out[many] = bucket_of(gram_hash(contexts[many], words[many]), bits)
    return out


def gram_rows(contexts: np.ndarray, words: np.ndarray, bits: int, dealt: np.ndarray):
    """Counted grams of a flush, one row a bucket; contexts are stored once with the length of their run."""
    _, at, counts = summed(gram_hash(contexts, words), np.ones(len(words), np.int64))
    contexts, words = contexts[at], words[at]
    bucket = gram_bucket(contexts, words, bits, dealt)
    order = np.lexsort((contexts, bucket))
    contexts, words, counts, bucket = contexts[order], words[order], counts[order].astype(np.uint32), bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
        new = np.flatnonzero(np.diff(contexts[lo:hi], prepend=~contexts[lo : lo + 1]))
        runs = np.diff(new, append=hi - lo).astype(np.uint32)
        rows.append((int(bucket[lo]), contexts[lo:hi][new].tobytes(), runs.tobytes(), words[lo:hi].tobytes(), counts[lo:hi].tobytes()))
    return rows


def write_sorted(path: str, keys: np.ndarray, **values: np.ndarray) -> None:
    write_bytes(f"{path}.keys", keys.tobytes())
    for name, v in values.items():
        write_bytes(f"{path}.{name}", v.tobytes())


@dataclass(frozen=True)
class Model:
    path: str
    bits: int
    word_bits: int
    gram_shards: frozenset[int]
    word_shards: frozenset[int]
    gram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_gamma: float
    n_grams: int
    n_words: int
    n_tokens: int
    #: Dealt contexts, sorted, with their totals and numbers of followers.
    dealt: tuple[tuple[int, ...], ...] = ()


def frequent_contexts(texts: DataFrame, bits: int) -> np.ndarray:
    """Words and START that precede at least FREQUENT / 2 ** bits of all tokens, and perhaps some that precede half as many;
    sorted. A flush reports what has half that share of it, so there are 2 ** (bits + 1) / FREQUENT at most for each flush
    and none is missed."""

    def count(batches):
        held = []

        def flush():
            contexts = np.concatenate(held)
            keys, _, n = summed(contexts, np.ones(len(contexts), np.int64))
            some = n >= len(contexts) * FREQUENT / 2 ** (bits + 1)
            held.clear()
            return pa.RecordBatch.from_pydict({"context": keys[some].view(np.int64), "n": n[some], "total": np.where(np.arange(some.sum()) == 0, len(contexts), 0)})

        for part in batches:
            for lo in range(0, part.num_rows, 512):
                held.append(contexts_of(*tokenize(part.column(0).slice(lo, 512))))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    parts = materialize(texts.mapInArrow(count, "context long, n long, total long"), "kneser-ney-frequent")
    total = parts.agg(F.sum("total")).first()[0] or 0
    found = parts.groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(total * FREQUENT / 2 ** (bits + 1)))
    return np.sort(np.array([r["context"] for r in found.collect()], np.int64).view(np.uint64))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of grams seen 1 to 4 times. Where those
    are too few for the estimate it is 0.5, 0.75 or 0.9; none is above its count or below 0."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [c - (c + 1) * y * above / here if here else None for c, here, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), c) if d else rest for d, c, rest in zip(raw, (1.0, 2.0, 3.0), (0.5, 0.75, 0.9)))


def train(texts: DataFrame, column: str = "text") -> Model:
    """Count and store the bigram model of all rows of texts. Null texts are empty: they add an end. Repeated rows count
    each time. Without rows the model knows nothing and gives every token probability 1 / (0 + 1)."""
    spark = texts.sparkSession
    read = texts.select(utf8(F.col(column)).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    word_bits = max(0, bits - 4)  # every gram bucket has a row for every word bucket
    path = fresh_path(spark, "kneser-ney")
    dealt = frequent_contexts(read, bits)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names, types = ["bucket", "contexts", "runs", "words", "counts"], [pa.int32(), *[pa.binary()] * 4]

        def flush():
            if held:
                yield batch(gram_rows(*(np.concatenate(x) for x in zip(*held)), bits, dealt), names, types)
                held.clear()

        for part in batches:
            for lo in range(0, part.num_rows, 512):
                tokens, lengths = tokenize(part.column(0).slice(lo, 512))
                held.append((contexts_of(tokens, lengths), tokens))
                if sum(len(t) for _, t in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    def close_grams(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        contexts = np.repeat(joined(table["contexts"], np.uint64), joined(table["runs"], np.uint32))
        words, counts = joined(table["words"], np.uint64), joined(table["counts"], np.uint32).astype(np.int64)
        keys, at, counts = summed(gram_hash(contexts, words), counts)
        contexts, words = contexts[at], words[at]
        write_sorted(f"{path}/grams/{bucket:06d}", keys, counts=counts.astype(np.uint32))
        heads, _, totals, one, two, more = summed(contexts, counts, *((counts == c).astype(np.int64) for c in (1, 2)), (counts > 2).astype(np.int64))
        followers = np.stack([totals, one, two, more], 1)
        whole = ~np.isin(heads, dealt)
        write_sorted(f"{path}/contexts/{bucket:06d}", heads[whole], followers=followers[whole])
        parted = [(-2, heads[i : i + 1].tobytes(), b"", b"", *(int(x) for x in followers[i]), 0, 0, None) for i in np.flatnonzero(~whole)]
        words, _, lefts, sums = summed(words, np.ones(len(words), np.int64), counts)
        rows, target = [], bucket_of(words, word_bits)
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            o = order[lo:hi]
            rows.append((int(target[o[0]]), words[o].tobytes(), lefts[o].astype(np.uint32).tobytes(), sums[o].tobytes(), 0, 0, 0, 0, 0, 0, None))
        tally = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
        rows += [(-1, b"", b"", b"", *tally, len(keys), int(counts.sum()), bucket), *parted]
        names = ["bucket", "words", "lefts", "counts", "n1", "n2", "n3", "n4", "grams", "tokens", "known"]
        return pa.Table.from_batches([batch(rows, names, [pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 6, pa.int32()])])

    def close_words(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, _, lefts, counts = summed(joined(table["words"], np.uint64), joined(table["lefts"], np.uint32).astype(np.int64), joined(table["counts"], np.int64))
        write_sorted(f"{path}/words/{bucket:06d}", keys, lefts=lefts, counts=counts)
        tally = [int((lefts == c).sum()) for c in (1, 2, 3, 4)]
        names = ["bucket", "n1", "n2", "n3", "n4", "words", "known"]
        return pa.Table.from_batches([batch([(bucket, *tally, len(keys), bucket)], names, [pa.int32(), *[pa.int64()] * 5, pa.int32()])])

    grams = read.mapInArrow(count, GRAM_ROWS)
    spread = materialize(grams.groupBy("bucket").applyInArrow(close_grams, WORD_ROWS), "kneser-ney-words")
    words = spread.where("bucket >= 0").groupBy("bucket").applyInArrow(close_words, WORD_STATS)
    numbers = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4")]
    low = words.agg(*numbers, F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.collect_list("known").alias("known")).first()
    high = spread.where("bucket = -1").agg(*numbers, F.coalesce(F.sum("grams"), F.lit(0)).alias("grams"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.collect_list("known").alias("known")).first()
    parts = spread.where("bucket = -2").groupBy("words").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4")]).collect()  # dealt contexts
    shared = tuple(sorted((int(np.frombuffer(r["words"], np.uint64)[0]), r["n1"], r["n2"], r["n3"], r["n4"]) for r in parts))
    drop_path(spark, spread.inputFiles()[0].rsplit("/", 1)[0]) if spread.inputFiles() else None
    d = discounts(low.n1, low.n2, low.n3, low.n4)
    gamma = (d[0] * low.n1 + d[1] * low.n2 + d[2] * (low.words - low.n1 - low.n2)) / high.grams if high.grams else 1.0
    return Model(path, bits, word_bits, frozenset(high.known), frozenset(low.known), discounts(high.n1, high.n2, high.n3, high.n4), d, gamma, high.grams, low.words, high.tokens, shared)


class Lookup:
    """The mapped files of a model in one worker, which keeps those of one model from task to task."""

    _kept: dict[str, Lookup] = {}

    def __init__(self, model: Model):
        self.model, self.files = model, {}
        table = np.array(model.dealt, np.uint64).reshape(-1, 5)
        self.dealt, self.followers = table[:, 0].copy(), table[:, 1:].astype(np.int64)

    @classmethod
    def of(cls, model: Model) -> Lookup:
        if model.path not in cls._kept:
            cls._kept = {model.path: cls(model)}
        return cls._kept[model.path]

    def _arrays(self, kind: str, bucket: int, values: dict):
        if (kind, bucket) not in self.files:
            base = f"{self.model.path}/{kind}/{bucket:06d}"
            n = size_of(f"{base}.keys") // 8
            self.files[kind, bucket] = mapped(f"{base}.keys", np.uint64, n), {name: mapped(f"{base}.{name}", dtype, n * width) for name, (dtype, width) in values.items()}
        return self.files[kind, bucket]

    def find(self, kind: str, buckets: np.ndarray, keys: np.ndarray, shards: frozenset[int], **values) -> dict[str, np.ndarray]:
        """Values of each key, 0 where it is unknown. values: name = (type, numbers a key)."""
        out = {name: np.zeros((len(keys), width) if width > 1 else len(keys), np.int64) for name, (_, width) in values.items()}
        order = np.lexsort((keys, buckets))
        cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            o = order[lo:hi]
            if int(buckets[o[0]]) in shards:
                known, held = self._arrays(kind, int(buckets[o[0]]), values)
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, keys[o]), len(known) - 1)
                hit = known[at] == keys[o]
                for name, (_, width) in values.items():
                    rows = held[name].reshape(-1, width) if width > 1 else held[name]
                    out[name][o[hit]] = rows[at[hit]]
        return out


def discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts > 0, counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def score_texts(lookup: Lookup, texts: pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    m = lookup.model
    tokens, lengths = tokenize(texts)
    contexts = contexts_of(tokens, lengths)
    types, where = np.unique(tokens, return_inverse=True)
    word = lookup.find("words", bucket_of(types, m.word_bits), types, m.word_shards, lefts=(np.int64, 1), counts=(np.int64, 1))
    low = (discounted(word["lefts"], m.word_discounts) / max(1, m.n_grams) + m.word_gamma / (m.n_words + 1))[where]
    base = np.log10((word["counts"] + 1) / (m.n_tokens + m.n_words + 1))[where]
    heads, place = np.unique(contexts, return_inverse=True)
    after = lookup.find("contexts", bucket_of(heads, m.bits), heads, m.gram_shards, followers=(np.int64, 4))["followers"]
    if len(lookup.dealt):
        at = np.minimum(np.searchsorted(lookup.dealt, heads), len(lookup.dealt) - 1)
        many = lookup.dealt[at] == heads
        after[many] = lookup.followers[at[many]]
    total = np.maximum(after[:, 0], 1)
    gamma = np.where(after[:, 0] > 0, after[:, 1:] @ np.array(m.gram_discounts) / total, 1.0)
    pairs = lookup.find("grams", gram_bucket(contexts, tokens, m.bits, lookup.dealt), gram_hash(contexts, tokens), m.gram_shards, counts=(np.uint32, 1))["counts"]
    p = discounted(pairs, m.gram_discounts) / total[place] + gamma[place] * low
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    known = (word["counts"] > 0)[where].astype(np.int64)
    return {"n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat(known, starts), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity for every row of docs. Null and empty texts are a lone
    end. Equal texts score the same. Very long texts are read whole. Other columns are not read."""

    def score(batches):
        lookup = Lookup.of(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                part = whole.slice(lo, 512)
                found = score_texts(lookup, part.column("text"))
                found["perplexity"] = 10.0 ** np.minimum(300, -found["score"] / found["n_tokens"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
