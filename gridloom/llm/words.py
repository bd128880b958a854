"""Words and rolling word-window hashes of many texts at once, as flat arrays."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of the rolling hashes, and of the final mixing.
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes: bytes.split() cuts at just the six ASCII spaces, 0x20 and 0x09 to 0x0D."""
    return text.split() if text else []


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word, all documents in a row, and the place where each document starts (one more at the end).

    Only one document's words are held at a time.
    """
    digest = xxhash.xxh64_intdigest
    each = [np.fromiter(map(digest, w), np.uint64, len(w)) for w in map(words, texts)]
    starts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=starts[1:])
    return np.concatenate([np.zeros(0, np.uint64), *each]), starts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), np.uint64(base))
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def window_hashes(h: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """The hash of the words [i, i + width) for each i, modulo 2^64; windows may cross documents, the caller leaves those out."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[lane]
    h = mixed(h + np.uint64(lane + 1))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=total[1:])
    back = _powers(pow(base, -1, 2**64), n)
    return mixed((total[width:] - total[:-width]) * back)
