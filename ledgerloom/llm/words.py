"""Words of texts as 64-bit numbers, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of each word, remembered for a bounded number of words."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between the six ASCII blanks; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def hashed(found: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def stirred(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (uint64, wraps)."""
    x = (x ^ (x >> np.uint64(32))) * _ODD1
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for a sequence ending in ``right``, in order."""
    return stirred(left * _ODD2 + right)


def shingles(numbers: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct numbers of all runs of ``width`` words, or of the whole if shorter."""
    if not len(numbers):
        return numbers
    span = min(width, len(numbers))
    made = numbers[: len(numbers) - span + 1] + np.uint64(span)
    for k in range(1, span):
        made = chained(made, numbers[k : len(numbers) - span + 1 + k])
    return np.unique(stirred(made))


def fingerprint(numbers: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    made = xxhash.xxh3_128_intdigest(numbers.tobytes())
    return signed(made >> 64), signed(made & _MASK)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def texts_of(batches: Iterable, *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as Python lists, a few hundred rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
