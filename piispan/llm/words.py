"""Words of many texts at once, as numpy arrays.

A word is a run of `[^\\x20\\x09-\\x0D]+`; the separators are ASCII, so words of UTF-8
bytes are words of code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (each input bit changes each output bit)."""
    x = (x ^ (x >> U(30))) * _K2
    x = (x ^ (x >> U(27))) * _K3
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of several texts: bytes of all texts, where words start and end, and each text's first word."""

    data: np.ndarray  # uint8, texts joined by \n, then 8 zero bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i, words first[i] .. first[i + 1]
    offsets: np.ndarray  # of text i, bytes offsets[i] .. offsets[i + 1] - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data - np.uint8(65)) <= 25, data + np.uint8(32), data)


def split(texts: list[bytes | None], lower: bool = False) -> Words:
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), dtype=np.uint8)
    if lower:
        data = lower_ascii(data)
    body = data[:-8]
    is_word = ~((body == 32) | ((body - np.uint8(9)) <= 4))
    edges = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(is_word) and is_word[0]:
        edges = np.concatenate(([0], edges))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    starts = edges[0::2]
    return Words(data, starts, edges[1::2], np.searchsorted(starts, offsets), offsets)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    lanes = np.ndarray(shape=(len(w.data) - 7,), dtype="<u8", buffer=w.data.tobytes() if not w.data.flags.c_contiguous else w.data, strides=(1,))
    length = w.ends - w.starts
    h = mix(length.astype(U) * _K1 + U(1))
    h = mix((h ^ (lanes[w.starts] & _MASKS[np.minimum(length, 8)])) * _K1)
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest):
        left = length[rest] - at
        h[rest] = mix((h[rest] ^ (lanes[w.starts[rest] + at] & _MASKS[np.minimum(left, 8)])) * _K1)
        rest, at = rest[left > 8], at + 8
    return h


_BASE = U(0x2545F4914F6CDD1D)  # odd
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of k consecutive words of one text, and the words they start at.

    With prefix sums S of h[i] * B^i, a window's hash is (S[i + k] - S[i]) * B^-i, modulo 2^64.
    """
    n = len(h)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s = np.zeros(n + 1, dtype=U)
    np.cumsum(h * _powers(_BASE, n), out=s[1:])
    rolled = (s[k:] - s[:-k]) * _powers(_INVERSE, n - k + 1)
    inside = np.ones(n - k + 1, dtype=bool)
    for e in range(1, k):  # windows that reach over a text's end
        over = first[1:-1] - e
        inside[over[(over >= 0) & (over <= n - k)]] = False
    at = np.flatnonzero(inside)
    return mix(rolled[at]), at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of `at`."""
    step = np.bincount(at, minlength=n + k + 1)[: n + k + 1].astype(np.int64)
    step[k:] -= step[: n + 1].copy()
    return np.cumsum(step)[:n] > 0
