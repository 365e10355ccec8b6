"""Hashed tokens of texts, and small fits, for models of language."""

import re
import sys
from functools import cache

import numpy as np
import xxhash

from panelspark.llm.bpe import Memory, chunks
from panelspark.llm.shingles import mix

_U = np.uint64
_TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
# Bytes of runs of text whose hashes a task remembers, in each of two generations; hashing one anew is cheap.
_REMEMBERED = 10 << 20
START = _U(0x5851F42D4C957F2D)
# Words are hashed eight bytes at a time, all words of many texts at once; longer ones one by one.
_STEP = 8
_LONGEST = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(_STEP + 1)], _U)


class TokenHashes:
    """The 64-bit hashes of a text's lower-cased tokens: words and, unless left out, runs of signs."""

    def __init__(self, words_only: bool = False):
        self.words_only = words_only
        self.memory = Memory(self._hash, _REMEMBERED)

    def _hash(self, chunk: str) -> bytes:
        found = _TOKENS.findall(chunk.lower())
        return b"".join(xxhash.xxh64_intdigest(t.encode()).to_bytes(8, "little") for t in found)

    def __call__(self, text: str | None) -> np.ndarray:
        if self.words_only:
            return word_hashes([text])[0]
        return np.frombuffer(b"".join(map(self.memory.__getitem__, chunks(text))), np.dtype("<u8"))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether words hold it, and its bytes in UTF-8."""
    n = sys.maxunicode + 1
    sizes = np.ones(n, np.uint8)
    for least in (0x80, 0x800, 0x10000):
        sizes[least:] += 1
    return np.fromiter((chr(p).isalnum() for p in range(n)), bool, n), sizes


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the lower-cased words of many texts, one text after the other, and where each text's end.

    Words are runs of letters and digits, as Python's patterns know them without the underscore.
    """
    lowered = [(t or "").lower() for t in texts]
    whole = "\n".join(["", *lowered, ""])
    of_words, sizes = _letters()
    points, buffer = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
    inside = of_words[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    ends = np.searchsorted(edges[::2], np.cumsum([len(t) + 1 for t in lowered]))
    if len(buffer) > len(points):
        edges = np.cumsum(sizes[points], dtype=np.int64)[edges - 1]
    return _span_hashes(buffer, edges[::2], edges[1::2]), ends


def _span_hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span of the buffer."""
    eight = np.ndarray(len(buffer) + 1, "<u8", buffer + bytes(_STEP), strides=(1,))
    left = ends - starts
    hashes = mix(left.astype(_U) * _U(0x2545F4914F6CDD1D) ^ eight[starts] & _FIRST_BYTES[np.minimum(left, _STEP)])
    for i in np.flatnonzero(left > _LONGEST).tolist():
        hashes[i] = xxhash.xxh64_intdigest(buffer[starts[i] : ends[i]])
    more = np.flatnonzero((left > _STEP) & (left <= _LONGEST))
    at, left = starts[more] + _STEP, left[more] - _STEP
    while len(more):
        hashes[more] = mix(hashes[more] ^ eight[at] & _FIRST_BYTES[np.minimum(left, _STEP)])
        on = left > _STEP
        more, at, left = more[on], at[on] + _STEP, left[on] - _STEP
    return hashes


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0xD6E8FEB86659FD93) ^ tokens)


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; the first follows a start mark."""
    return pair_hashes(contexts(tokens), tokens)


def contexts(tokens: np.ndarray, ends: np.ndarray | None = None, start: np.integer = START) -> np.ndarray:
    """The token before each, a start mark before the first; of many texts, before the first of each."""
    before = np.concatenate(([start], tokens[:-1])) if len(tokens) else tokens
    if ends is not None:
        before[ends[ends < len(tokens)]] = start
    return before


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on standardised features by Newton steps: means, scales, weights (the last is the offset)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    weights = np.zeros(z.shape[1])
    ridge = np.full(len(weights), penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (p - y) + ridge * weights
        curvature = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curvature, gradient)
        weights = weights - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, weights


def logits(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, weights = fit
    return np.clip((x - mean) / scale @ weights[:-1] + weights[-1], -500, 500)
