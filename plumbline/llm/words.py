"""Words between ASCII blanks and hashes of runs of them, inside tasks."""

import numpy as np
import pyarrow as pa
import xxhash


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    """A column of texts as UTF-8 bytes; null stays None."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def rolling_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words, from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
