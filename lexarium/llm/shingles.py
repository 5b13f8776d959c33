"""Sets of word shingles as 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: A-Z lower-cased, other bytes as they are; white space marks.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose words are hashed at once; bounds the memory that a very long text takes.
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def marks_as_white() -> np.ndarray:
    """White space for comparisons that punctuation doesn't matter to: ASCII marks separate words too."""
    out = _WHITE.copy()
    out[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    return out


def word_hashes(texts: list[bytes], white_bytes: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin among them (one more entry than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    white = white_bytes[data]
    first = ~white
    first[1:] &= white[:-1]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # whole words, some at a time: numbers take eight bytes for each byte of text
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        low, high = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
        own = starts[i:j] - low
        values = _LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)
        values[white[low:high]] = 0
        sizes = np.diff(own, append=high - low)
        place = np.arange(high - low) - np.repeat(own, sizes)
        values *= np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))[place]
        out[i:j] = mix(np.add.reduceat(values, own))
        i = j
    return out, bounds


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` of the hashes."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return mix(out)


def blocks(texts: list[bytes], size: int = 2_000_000):
    """The texts, some at a time: (first, texts) of about ``size`` bytes, or one text if that is longer."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct ``n``-word shingle hashes; one hash of all words if it has fewer, none without words."""
    out: list[np.ndarray] = []
    for _, block in blocks(texts):
        words, bounds = word_hashes(block)
        runs = combine(words, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(runs[a : b - n + 1]))
            else:
                out.append(combine(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (texts x m) of non-empty sets.

    Each element draws a random permutation of the m places, one swap a step, and offers the place that step j gives
    the value j + random. Later steps offer larger values only, so a text is done after step j when all its places
    hold less than j + 1: one or two steps for most texts. Values are j and 40 random bits in one number.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    signature = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    h, owner = (np.concatenate(sets), np.repeat(np.arange(n), sizes)) if n else (np.empty(0, np.uint64), np.empty(0, int))
    places: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for j in range(m):
            draw = mix(h + _ODD * np.uint64(j + 1))
            k = j + ((draw & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
            if places is None:
                chosen = k
            else:
                row = np.arange(len(h))
                chosen = places[row, k].astype(np.int64)
                places[row, k] = places[:, j]
                places[:, j] = chosen
            np.minimum.at(signature, owner * m + chosen, (np.uint64(j) << np.uint64(40)) | (draw >> np.uint64(24)))
            undone = signature.reshape(n, m).max(axis=1) >= np.uint64((j + 1) << 40)
            stay = undone[owner]
            if not stay.any():
                break
            if places is None:
                h, owner, chosen = h[stay], owner[stay], chosen[stay]
                places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(h), 1))
                places[np.arange(len(h)), chosen] = 0
                places[:, 0] = chosen
            elif stay.sum() < 0.7 * len(h):
                h, owner, places = h[stay], owner[stay], places[stay]
    return signature.reshape(n, m)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` places; the number of the band is part of it."""
    n, m = signature.shape
    bands = signature.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)).copy()
    for k in range(rows):
        out = out * _BASE + bands[:, :, k]
    return mix(out).view(np.int64)
