"""Anchors of byte texts: places that all equal strings of a given length agree on.

Of the k-grams inside a string the one with the smallest hash is its anchor. Equal strings have anchors with equal
hashes at equal offsets, so strings are only to be compared within the group of an anchor's hash. Consecutive starts
with one anchor make a segment: at most ``width - K + 1`` starts, and the bytes that their strings cover.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

#: Bytes in an anchor, and bytes of text that are handled at once.
K, CHUNK = 32, 1 << 19


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK + 512, base, np.uint64)]))


#: Powers of two odd bases and of their inverses: running sums with them give the hash of any run of bytes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS, _POWERS_2 = (_powers(b) for b in _BASES)
_INVERSES, _INVERSES_2 = (_powers(pow(b, -1, 1 << 64)) for b in _BASES)


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values: running minima of blocks from both sides."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(text: bytes, width: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, two hashes of the content, first start, number of starts, and the anchor's place from the first start, of the segments of one text in order."""
    out = []
    w = width - K + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - width + 1), CHUNK):
        part = data[at : at + CHUNK + width - 1].astype(np.uint64) + np.uint64(1)
        sums, sums_2 = np.zeros(len(part) + 1, np.uint64), np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[: len(part)], out=sums[1:])
        np.cumsum(part * _POWERS_2[: len(part)], out=sums_2[1:])
        grams = mix((sums[K:] - sums[:-K]) * _INVERSES[: len(part) - K + 1])
        # ties go to the first place: it takes the low bits of what is compared
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64(20)
        smallest = _smallest((grams >> low << low) | place, w)
        anchor = (smallest & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(anchor))
        end = first + n + width - 1
        sized = n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        content = mix((sums[end] - sums[first]) * _INVERSES[first] + sized)
        content_2 = mix((sums_2[end] - sums_2[first]) * _INVERSES_2[first] + sized)
        out.append((grams[anchor[first]], content, content_2, first + at, n, anchor[first] - first))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))
