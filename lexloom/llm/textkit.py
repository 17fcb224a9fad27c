"""Words of many texts at once in numpy: boundaries, 64-bit hashes, word shingles.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A slice of texts takes about 40 bytes of memory per byte of text.
"""

from __future__ import annotations

import numpy as np

_KIND = np.zeros(256, dtype=bool)
_KIND[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.RandomState(20240229)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_LANES = (_RANDOM.randint(0, 2**63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)).tolist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PLACES = 64
#: A random value for each byte at each of the first places of a word; bytes at later places are mixed with their place.
_TABLE = _RANDOM.randint(0, 2**63, _PLACES * 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + _RANDOM.randint(0, 2, _PLACES * 256).astype(np.uint64)


class Words:
    """The words of a list of texts: `start`, `end` in `raw` (lower-cased bytes), and `first[d]:first[d + 1]` are those of text d."""

    def __init__(self, texts: list[str]):
        encoded = [x.encode() for x in texts]
        self.size = np.array([len(x) for x in encoded], dtype=np.int64)
        self.bytes = b"\n".join(encoded) + b"\n"
        self.raw = np.frombuffer(self.bytes.lower(), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])  # text d lies from at[d] to at[d + 1] - 1
        space = _KIND[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self) -> np.ndarray:
        """A hash of each word: the sum of values that depend on byte and place alike, so that no pattern of letters cancels out."""
        size = len(self.raw)
        # one 32-bit array for the places in words and then the table's entries; all steps in place
        opening = np.zeros(size, dtype=np.int32)
        opening[self.start] = self.start
        np.maximum.accumulate(opening, out=opening)
        entry = np.arange(size, dtype=np.int32)
        entry -= opening
        del opening
        far = np.flatnonzero(entry >= _PLACES)
        beyond = (entry[far].astype(np.uint64) << np.uint64(8)) + self.raw[far] + np.uint64(_MULTIPLIER)
        np.minimum(entry, _PLACES - 1, out=entry)
        entry <<= 8
        entry += self.raw
        total = np.zeros(size + 1, dtype=np.uint64)
        np.take(_TABLE, entry, out=total[1:], mode="clip")
        del entry
        total[1:][far] = mix(beyond)
        np.cumsum(total, out=total)
        return mix(total[self.end] - total[self.start])


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as rising 64-bit hashes; a text of fewer words has its whole sequence as one, one without words none."""
    w = Words(texts)
    h = w.hashes()
    out = []
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, dtype=np.uint64)
        for k in range(words):
            s += h[k : len(h) - words + 1 + k] * np.uint64(_LANES[k])
        s = mix(s)
    else:
        s = np.zeros(0, dtype=np.uint64)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
        if b - a >= words:
            own = np.sort(s[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            for k in range(a, b):
                short = mix(np.array([short], dtype=np.uint64) * np.uint64(_MULTIPLIER) + h[k])[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
