"""Word shingle sets of texts, hashed by whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time.
CHUNK = 1 << 17

_random = np.random.default_rng(20240229)
#: A random number for each byte; A-Z have those of a-z.
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of letters: all of ASCII but letters.
LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_STEP, _MIX, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: bytes, ends: np.ndarray = _SPACE, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word, or of its first ``prefix`` bytes; A-Z count as a-z, words are cut at the bytes that ``ends`` marks, ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    space = ends[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.array([], np.uint64)
    size = end - start
    letters = raw[~space]
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    part = _BYTE[letters] * _powers(int(size.max()))[place]
    if prefix:
        part[place >= prefix] = 0
    h = np.add.reduceat(part, first)
    return start, mix(h + (np.full(len(h), 1 << 40 | prefix, np.uint64) if prefix else size.astype(np.uint64)) * _MARK)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while len(data) - at > 16 * CHUNK:
        cut = max(data.rfind(b" ", at, at + 16 * CHUNK), data.rfind(b"\n", at, at + 16 * CHUNK))
        if cut <= at:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


@np.errstate(over="ignore")
def _short(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return mix((hashes * weight).sum(keepdims=True) + np.uint64(len(hashes)) * _MARK)


def _sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The shingle sets of texts whose words are ``hashes[bounds[i]:bounds[i + 1]]``."""
    weight = _powers(k + 1)[1:]
    n = len(hashes) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * weight[j]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield _short(hashes[a:b], weight[: b - a])
        else:
            yield np.array([], np.uint64)


def _hashed(texts: list[str], ends: np.ndarray, prefix: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of several texts at a time, and where each text's begin and end among them."""
    held: list[bytes] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum([0, *(len(x) + 1 for x in held)])
        start, hashes = word_hashes(b"\n".join(held), ends, prefix)
        held.clear()
        return hashes, np.searchsorted(start, first)

    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:
            if held:
                yield flush()
                total = 0
            hashes = np.concatenate([word_hashes(p, ends, prefix)[1] for p in _pieces(data)])
            yield hashes, np.array([0, len(hashes)])
            continue
        held.append(data)
        total += len(data)
        if total > CHUNK:
            yield flush()
            total = 0
    if held:
        yield flush()


def text_words(texts: list[str], ends: np.ndarray = _SPACE, prefix: int = 0) -> Iterator[np.ndarray]:
    """Each text's word hashes in order, or those of its words' first ``prefix`` bytes."""
    for hashes, bounds in _hashed(texts, ends, prefix):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield hashes[a:b]


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; with fewer words, the whole sequence as one; without words, none."""
    for hashes, bounds in _hashed(texts, _SPACE):
        yield from _sets(hashes, bounds, k)


@np.errstate(over="ignore")
def set_id(s: np.ndarray) -> int:
    """A set's number: equal sets have the same, the empty set has 0."""
    if not len(s):
        return 0
    h = mix(np.array([s.sum() + np.uint64(len(s)) * _MARK, np.bitwise_xor.reduce(mix(s + _MARK))]))
    return int((h[0] * _STEP + h[1]).view(np.int64)) or 1


@np.errstate(over="ignore")
def pair_ids(pairs: np.ndarray) -> np.ndarray:
    """set_id of every row of two."""
    a = mix(pairs.sum(axis=1, dtype=np.uint64) + np.uint64(2) * _MARK)
    b = mix(np.bitwise_xor.reduce(mix(pairs + _MARK), axis=1))
    out = (a * _STEP + b).view(np.int64)
    out[out == 0] = 1
    return out
