"""Numpy kernels over UTF-8 bytes that the Python stages of this subpackage share.

A text is hashed once by a prefix sum over its bytes, modulo 2^64.  The hash of any
substring is then one subtraction and one multiplication, so n-gram, window and word
hashes of a whole text are a few array operations and no Python loop over its words.
"""

from __future__ import annotations

import numpy as np

from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

MASK64 = (1 << 64) - 1
#: Odd multipliers of two independent substring hashes, and the seed of their byte tables.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEED = 20_011

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_bytes: dict[int, np.ndarray] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each; kept between texts."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        tables = []
        for base in (MULTIPLIERS[which], pow(MULTIPLIERS[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        have = _powers[which] = (tables[0], tables[1])
    return have


def _byte_table(which: int) -> np.ndarray:
    if which not in _bytes:
        _bytes[which] = np.random.default_rng(SEED + which).integers(1, MASK64, 256, dtype=np.uint64)
    return _bytes[which]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of substrings of one byte string."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _power_tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_table(which)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``start`` to before ``end``, elementwise."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, width: int) -> np.ndarray:
        """Hash of every substring of ``width`` bytes, by its start."""
        count = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:count]) * self.down[:count])


def as_bytes(text: str | bytes | None) -> np.ndarray:
    """UTF-8 bytes of a text; none for null."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return np.frombuffer(raw, np.uint8)


_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: str | bytes | None, fold: bool = True) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` in text order; ``fold`` lower-cases A-Z first."""
    data = as_bytes(text)
    if not len(data):
        return np.empty(0, np.uint64)
    if fold:
        data = _fold[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _space[data], [True])).view(np.int8)))
    return Substrings(data)(edges[0::2], edges[1::2])


_STEPS = tuple(pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, by the first of them."""
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * np.uint64(_STEPS[k + 1])
    return mix(total)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row, sorted; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    return np.unique(runs(words, min(width, len(words))))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by the first of them."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, MASK64, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
