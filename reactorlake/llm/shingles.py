"""Word shingles of many texts at once: Arrow splits, numpy hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII white space apart, A-Z lower-cased) and each text's first word's position."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values, offsets = words.values, words.offsets.to_numpy()
    keep = pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return hashes[coded.indices.to_numpy()][keep], bounds


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text of fewer words than
    ``width`` has its whole sequence as one shingle; one without words has none."""
    words, bounds = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        grams += words[i : i + len(grams)] * _ODD[i]
    grams = scramble(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:  # the length keeps a short sequence apart from its longer neighbours
            short = np.uint64(b - a) + (words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64)
            out.append(scramble(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
