"""Word hashes of whole columns of texts, for the operators that count in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and where each text's words begin and end. Null texts are empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end makes an empty word
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
    encoded = flat.filter(pa.array(keep)).dictionary_encode()
    if not len(encoded):
        return np.empty(0, np.uint64), offsets
    types = pd.util.hash_array(encoded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return types[encoded.indices.to_numpy(zero_copy_only=False)], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    """A record batch from rows, which may be none."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The numbers in a column of binaries, one after the other."""
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in column]) if len(column) else np.empty(0, dtype)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
