"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are hashed at once, and of a word that is hashed by the table.
STEP, LONG = 1 << 20, 64
_rng = np.random.default_rng(20240301)
#: One random number per byte and place in a word, and a random odd multiplier per place in a shingle.
_TABLE = _rng.integers(0, 2**64, LONG * 256, np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the runs of bytes between ASCII white space: the sum of the numbers of their bytes at their places."""
    raw = np.frombuffer(body, np.uint8)
    white = _WHITE[raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(raw)]]) if len(raw) else np.zeros(0, np.int64)
    first = 1 if len(raw) and white[0] else 0
    start, end = edge[first:-1:2], edge[first + 1 :: 2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = end - start
    upto = np.cumsum(size)
    at = np.flatnonzero(~white)
    place = np.arange(len(at)) - np.repeat(upto - size, size)
    h = np.add.reduceat(_TABLE[(np.minimum(place, LONG - 1) << 8) + raw[at]], upto - size)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(body[start[i] : end[i]])
    return start, h


def _sorted(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]]


def many_shingles(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """shingles() of each text; short texts are hashed together."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        body = text.encode().lower()  # of bytes, so only A-Z change
        if held and size + len(body) > STEP:
            yield from _together(held, width)
            held, size = [], 0
        held.append(body)
        size += len(body) + 1
    if held:
        yield from _together(held, width)


def _together(bodies: list[bytes], width: int) -> Iterator[np.ndarray]:
    start, w = words(b"\n".join(bodies))
    sizes = np.array([len(b) + 1 for b in bodies])
    cuts = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    n = len(w) - width + 1
    if n > 0:
        h = np.full(n, width, np.uint64)
        for i in range(width):
            h += w[i : n + i] * _PLACE[i]
        h = mixed(h)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            yield _sorted(h[a : b - width + 1])
        elif b > a:
            own = (w[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mixed(np.array([own], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `width` words, of A-Z lower-cased text split at ASCII
    white space; of all words together if there are fewer, and nothing without words."""
    return next(many_shingles([text], width))
