"""Vectorised words, word hashes and shingles over the bytes of whole texts.

A text is handled as UTF-8. Words are maximal runs of non-separator bytes, so every
byte above 0x7F belongs to a word. Hashes are 64 bits wide; a word's hash is a
polynomial over a random byte table, made for all words at once from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (texts are lower-cased before).
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else _INV
        out = np.full(max(n, CHUNK_BYTES * 2), base, np.uint64)
        out[0] = 1
        _powers[kind] = np.cumprod(out)
    return _powers[kind][:n]


@dataclass
class Words:
    """Words of a run of texts: byte spans in data, hashes, and word offsets by text."""

    data: np.ndarray  # lower-cased bytes
    text_at: np.ndarray  # byte offset of each text, one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each text, one more than texts

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(row, texts from that row) in runs of about limit bytes; one text may be longer."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))]).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, null as empty, and each text's offset."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(texts: pa.Array, separator: np.ndarray) -> Words:
    data, text_at = raw_bytes(texts)
    data = LOWER[data]
    n = len(data)
    inside = ~separator[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = text_at[(text_at > 0) & (text_at < n)]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n), out=total[1:])
    h = mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))
    return Words(data, text_at, start, end, h, np.searchsorted(start, text_at))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k words from each word on, and which of them stay inside one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h[: n - k + 1] += w.hash[j : n - k + 1 + j] * _POS[j % 64] + np.uint64(j)
    ok = np.zeros(n, bool)
    last = np.repeat(w.first[1:], np.diff(w.first))
    ok[: n - k + 1] = np.arange(k, n + 1) <= last[: n - k + 1]
    return mix(h + np.uint64(k)), ok


def whole(h: np.ndarray) -> int:
    """The hash of a short word sequence as one shingle."""
    return int(mix(np.array([(h * _POS[: len(h)]).sum(dtype=np.uint64) + np.uint64(1000 + len(h))], np.uint64))[0])


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """By text, the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence as one."""
    w = words(texts, SPACE)
    h, ok = grams(w, k)
    out = []
    for i in range(len(texts)):
        at, to = w.first[i], w.first[i + 1]
        if to - at >= k:
            s = np.sort(h[at : to - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif to > at:
            out.append(np.array([whole(w.hash[at:to])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
