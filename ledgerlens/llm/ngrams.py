"""Hashed character n-grams of batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT_CHARS = 1_000_000   # a longer text is taken in overlapping segments
CHUNK_CHARS = 1_500_000     # characters worked on together
CHUNK_TEXTS = 512

MIX = np.uint32(0x9E3779B1)


def _segments(texts: list[str], overlap: int) -> Iterator[tuple[int, str, int]]:
    """(text number, characters, first positions that count): windows of up to
    overlap + 1 characters are seen whole and once."""
    for i, t in enumerate(texts):
        if len(t) <= SEGMENT_CHARS:
            if t:
                yield i, t, len(t)
            continue
        for s in range(0, len(t), SEGMENT_CHARS):
            yield i, t[s:s + SEGMENT_CHARS + overlap], min(SEGMENT_CHARS, len(t) - s)


def chunks(texts: list[str], overlap: int) -> Iterator[list[tuple[int, str, int]]]:
    """Segments in lists of bounded total length."""
    held, size = [], 0
    for seg in _segments(texts, overlap):
        if held and (size + len(seg[1]) > CHUNK_CHARS or len(held) >= CHUNK_TEXTS):
            yield held
            held, size = [], 0
        held.append(seg)
        size += len(seg[1])
    if held:
        yield held


def hashed(segments: list[tuple[int, str, int]], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, segment) of every character n-gram of the given orders."""
    codes = np.frombuffer("".join(s for _, s, _ in segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(s) for _, s, _ in segments), np.int64, len(segments))
    own = np.fromiter((n for _, _, n in segments), np.int64, len(segments))
    ends = np.cumsum(lengths)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
    at = np.arange(len(codes))
    room = ends[segment] - at                       # characters up to the segment's end
    counts = at - (ends - lengths)[segment] < own[segment]
    bins, owners = [], []
    for n in orders:
        ok = counts & (room >= n) if n > 1 or not counts.all() else None
        h = np.full(max(0, len(codes) - n + 1), n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:k + len(h)]) * MIX
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
        if ok is None:
            bins.append(h)
            owners.append(segment)
        else:
            bins.append(h[ok[:len(h)]])
            owners.append(segment[:len(h)][ok[:len(h)]])
    return np.concatenate(bins), np.concatenate(owners)
