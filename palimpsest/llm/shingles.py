"""Words and shingles of whole texts as 64-bit numbers, a batch at a time.

Arrow splits a batch into words and numbers the distinct ones, each distinct
word is hashed once, and numpy combines the hashes of adjacent words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xC2B2AE3D27D4EB4F)


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of the batch in them, and each text's bounds.

    Words are runs of characters other than blank and the controls 9 to 13.
    With ``lower``, A-Z (and no other letters) are lower-cased.
    """
    texts = texts.cast(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = parts.flatten()
    bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, bounds = words.filter(pa.array(full)), before[bounds]
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text, the ascending distinct hashes of its runs of ``size`` words.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    words, codes, bounds = word_codes(texts)
    hashed = hash_words(words)[codes]
    m = max(0, len(hashed) - size + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + hashed[k : k + m]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            own = np.array([b - a], np.uint64)
            for h in hashed[a:b]:
                own = own * _SHORT + h
            out.append(mixed(own))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
