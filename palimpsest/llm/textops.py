"""Word scanning and hashing on byte buffers, shared by the operators that run in Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Words are runs of bytes other than ASCII white space.
SPACED = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else LOWER.get(b, b) for b in range(256))
#: Words are runs of ASCII letters, digits and whatever is not ASCII.
ALNUM = bytes(
    LOWER.get(b, b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def bucket(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.multiply.accumulate(np.array([1] + [base] * (size - 1), np.uint64))
                for base in (_BASE, _INVERSE)
            )
    return _powers


class Words(NamedTuple):
    """Words of a batch of texts: byte spans in buf, 64-bit hashes, and for each text its first word."""

    buf: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = _power_tables(len(buf))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf + np.uint64(1)) * power[: len(buf)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def scan(texts: list[bytes], table: bytes) -> Words:
    """Find and hash the words of all texts at once. The hash of a word depends on its bytes only."""
    joined = (b" ".join(texts) + b" ").translate(table)
    buf = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(buf) + 1, np.int8)
    inside[0] = 0
    np.not_equal(buf, 32, out=inside[1:].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(buf, starts, ends)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(joined, starts, ends, hashes, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; one per start that has n."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[i : len(hashes) - n + 1 + i]
        return mix64(out + np.uint64(n))


def assembled(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray, long: int = 1 << 16, step: int = 1 << 19) -> np.ndarray:
    """The given spans of source one after another in one new buffer: short spans by index arrays, long ones as slices."""
    ends = np.cumsum(lengths)
    to = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in np.flatnonzero(lengths >= long).tolist():
        out[to[i] : ends[i]] = source[starts[i] : starts[i] + lengths[i]]
    short = np.flatnonzero(lengths < long)
    sums = np.cumsum(lengths[short])
    cuts = np.searchsorted(sums, np.arange(step, int(sums[-1]) + step, step)) if len(sums) else []
    for one in np.split(short, cuts):
        size = lengths[one]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to[one], size) + inner] = source[np.repeat(starts[one], size) + inner]
    return out


def chunks(texts, limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of at most limit bytes together; nulls are empty."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(data) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held
