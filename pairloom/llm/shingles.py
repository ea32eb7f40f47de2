"""Hashed word shingles of Arrow batches of texts.

Words are what white space (0x20, 0x09-0x0D) parts, A-Z lower-cased. A shingle is a run of n words; a
text with fewer words, but not none, has its whole sequence as one. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def coded_words(texts) -> tuple:
    """Of an Arrow array of texts (null: none): words (some perhaps twice), each place's word, and where each text's places end, from a 0 on."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = split.offsets.to_numpy()
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words = pc.ascii_lower(coded.dictionary)  # distinct words only; and ascii_lower misreads arrays that are slices
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[codes] if len(words) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return words, codes[real].astype(np.int64), ends


def hashes_of(words) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow array of texts (null: none), and where each text's words end, from a 0 on."""
    words, codes, ends = coded_words(texts)
    return hashes_of(words)[codes], ends


def shingle_sets(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, end to end, and where each text's end, from a 0 on."""
    words, ends = word_hashes(texts)
    count = np.diff(ends)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(runs)])
    doc = np.repeat(np.arange(len(count)), runs)
    first = ends[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    length = np.minimum(count[doc], n)
    h = length.astype(np.uint64) * M1
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = k < length
            h[inside] = mix(h[inside] * M1 + words[first[inside] + k] + np.uint64(k))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(count)))])


def signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + M1), dtype=np.uint64)])
        n = np.diff(ends)
        out = mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64) * M2)
    out[n == 0] = 0
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
