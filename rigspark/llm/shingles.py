"""Shingle sets of whole texts as sorted 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
#: Bytes of text hashed at a time: its tables stay in a core's cache.
_SLICE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.where(_SPACE, np.uint64(0), np.random.Generator(np.random.Philox(key=8)).integers(0, 2**64, 256, dtype=np.uint64))
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _word_hashes(raw: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a byte array that ends with white space; bytes count by place, and words from their start."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    values = _BYTE[raw]
    values *= powers[:len(raw)]
    return starts, mix(np.add.reduceat(values, starts) * inverse[starts] + (ends - starts[:len(ends)]).astype(np.uint64))


def shingle_table(texts: list[bytes | None], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of ``words`` words of all texts, one text after the other and sorted in each, and their number per text.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words is one shingle; without words, none.
    """
    sizes = [len(t) + 1 if t else 1 for t in texts]
    raw = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).lower(), np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    powers, inverse = _powers(_POWER, _SLICE), _powers(_INVERSE, _SLICE)
    while at < len(raw):  # slices end at white space, so no word is cut
        end = min(at + _SLICE, len(raw))
        last = np.flatnonzero(_SPACE[raw[at:end]][::-1][:1024])
        if len(last):
            end -= int(last[0])
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            tail = np.flatnonzero(_SPACE[raw[end:end + _SLICE]])
            end = min(end + (int(tail[0]) + 1 if len(tail) else _SLICE), len(raw))
        p, q = (powers, inverse) if end - at <= _SLICE else (_powers(_POWER, end - at), _powers(_INVERSE, end - at))
        s, h = _word_hashes(raw[at:end], p, q)
        starts.append(s + at)
        hashes.append(h)
        at = end
    start, word = np.concatenate(starts), np.concatenate(hashes)
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    n = np.diff(first)
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for size in range(1, words + 1):
        which = np.flatnonzero(n == size if size < words else n >= words)
        at = np.repeat(first[which] - np.cumsum(counts[which]) + counts[which], counts[which]) + np.arange(int(counts[which].sum()))
        h = np.full(len(at), np.uint64(size))
        for k in range(size):
            h *= _POWER
            h += word[at + k]
        out[np.repeat(begins[which] - np.cumsum(counts[which]) + counts[which], counts[which]) + np.arange(len(at))] = mix(h)
    for a, b in zip(begins.tolist(), ends.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begins[counts > 0]] = True
    seen = np.concatenate([[0], np.cumsum(new)])
    return out[new], seen[ends] - seen[begins]


def shingle_sets(texts: list[bytes | None], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sets of ``shingle_table`` one by one."""
    tokens, counts = shingle_table(texts, words)
    ends = np.cumsum(counts)
    return [tokens[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
