"""Sets of hashed five-word shingles, many texts at a time in numpy."""

import numpy as np

WIDTH = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(n, base, _U)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of bytes other than 20 and 09 to 0D starts and ends; the last byte must be one of these."""
    inside = np.concatenate(([False], ~_SPACE[buffer]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span of the buffer, from two prefix sums of one rolling hash."""
    up, down = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, _U)
    np.cumsum(_BYTES[buffer] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x2545F4914F6CDD1D))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of every text, and the index of its text.

    Texts are lower-cased in A-Z; words are runs of bytes other than 20 and 09 to 0D.
    """
    texts = [t or b"" for t in texts]
    buffer = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts, ends = word_spans(buffer)
    hashes = span_hashes(buffer, starts, ends)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words has one shingle, its whole sequence; one
    without words, or NULL, has none.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    long_enough = len(words) - width + 1
    rolled = np.zeros(max(long_enough, 0), _U)
    for i in range(width if long_enough > 0 else 0):
        rolled += words[i : i + long_enough] * _PLACES[i]
    rolled = mix(rolled + _U(width))
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            out.append(np.unique(rolled[first[i] : first[i + 1] - width + 1]))
        elif n:
            short = words[first[i] : first[i + 1]] * _PLACES[:n]
            out.append(mix(short.sum(dtype=_U).reshape(1) + _U(n)))
        else:
            out.append(np.empty(0, _U))
    return out
