"""numpy kernels over UTF-8 bytes, used inside Arrow batches.

A byte string is hashed as sum(table[b[i]] * P**i) modulo 2**64. Running sums give the hash of
every substring in constant time, so all words (or all k-byte strings) of a megabyte of text cost a
few array passes. P is odd, hence invertible, which makes hashes independent of the position.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 1 << 64)
_U = np.uint64
PIECE = 1 << 20  # bytes worked on at once


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads each input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("p", _P), ("i", _IP)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["i"]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = hash of buf[i:j] times P**i."""
    p, _ = _powers_to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers_to(len(sums))
    return (sums[ends] - sums[starts]) * inverse[starts]


def byte_class(separators: str | bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators if isinstance(separators, bytes) else separators.encode(), dtype=np.uint8)] = True
    return table


WHITE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Everything ASCII but digits and letters; bytes of other characters count as word bytes.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def bounds(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Batch:
    """Texts joined into one buffer; ``first`` has each text's offset, texts are parted by a separator byte."""

    def __init__(self, texts: list[bytes], part: bytes = b"\n"):
        self.buf = np.frombuffer(part.join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = np.zeros(len(texts), dtype=np.int64)
        np.cumsum(sizes[:-1] + len(part), out=self.first[1:])
        self.size = sizes

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The index of the text that holds each offset."""
        return np.searchsorted(self.first, at, side="right") - 1


def batches(texts: list[bytes], most: int = PIECE):
    """(first, last, texts[first:last]) with about ``most`` bytes each; one text is never split."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end]) + 1
            end += 1
        yield at, end, texts[at:end]
        at = end


def cut_at(text: bytes, separators: np.ndarray, most: int = PIECE):
    """Pieces of a long text, cut only at separator bytes (a run without any stays whole)."""
    at = 0
    while len(text) - at > most:
        window = np.frombuffer(text, dtype=np.uint8, count=most, offset=at)
        found = np.flatnonzero(separators[window])
        if len(found):
            end = at + int(found[-1]) + 1
        else:
            rest = np.flatnonzero(separators[np.frombuffer(text, dtype=np.uint8, offset=at + most)])
            end = at + most + (int(rest[0]) + 1 if len(rest) else len(text) - at - most)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def only_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, hashes): the hashes of all words in order; text i has hashes[cuts[i]:cuts[i + 1]]. Places are not kept."""
    counts, hashes = np.zeros(len(texts) + 1, dtype=np.int64), []
    for a, b, some in batches(texts):
        if b - a == 1 and len(some[0]) > PIECE:
            for _, piece in cut_at(some[0], separators):
                buf = np.frombuffer(piece, dtype=np.uint8)
                s, e = bounds(buf, separators)
                hashes.append(mix(span_hashes(prefix_sums(buf), s, e)))
                counts[a + 1] += len(s)
            continue
        batch = Batch(some)
        s, e = bounds(batch.buf, separators)
        hashes.append(mix(span_hashes(prefix_sums(batch.buf), s, e)))
        counts[a + 1 : b + 1] = np.bincount(batch.owner(s), minlength=b - a)
    return np.cumsum(counts), np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: list[bytes], separators: np.ndarray):
    """(owner, start, end, hash) of every word of all texts, in order; starts are offsets in the own text."""
    owners, starts, ends, hashes = [], [], [], []
    for a, b, some in batches(texts):
        if b - a == 1 and len(some[0]) > PIECE:
            for at, piece in cut_at(some[0], separators):
                buf = np.frombuffer(piece, dtype=np.uint8)
                s, e = bounds(buf, separators)
                hashes.append(span_hashes(prefix_sums(buf), s, e))
                owners.append(np.full(len(s), a))
                starts.append(s + at)
                ends.append(e + at)
            continue
        batch = Batch(some)
        s, e = bounds(batch.buf, separators)
        hashes.append(span_hashes(prefix_sums(batch.buf), s, e))
        own = batch.owner(s)
        owners.append(own + a)
        starts.append(s - batch.first[own])
        ends.append(e - batch.first[own])
    if not owners:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(starts), np.concatenate(ends), mix(np.concatenate(hashes))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; a shorter sequence is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _U(0x2545F4914F6CDD1D) + words[i : n - k + 1 + i])
    return out
