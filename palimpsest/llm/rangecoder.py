"""Adaptive context-mixing range coder for token ids: the blocks of a frame, side by side.

A frame's ids are cut into blocks of BLOCK. Every block starts from the same state and is coded apart from the
others. That state is the frame's: how often each id occurs (order 0) and how often ids follow an id (order 1), stored once a
frame. From there a block adapts to itself: it keeps the id that last came after two ids (order 2) and how well it
has held, and learns how often such predictions come true, by their record and by the latest outcomes. Both chances are
mixed in the logistic domain with weights that learn from each outcome. The outcome narrows the range; where the
prediction fails, the id's share of the order-1 frequencies does, or the escape's share and then that of order 0.

Blocks are the lanes of numpy arrays: one step codes the next id of all of them. Everything is whole-number
arithmetic, so that decoding repeats encoding exactly. Ids are below 65535.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
TABLE_BITS = 11
SCALE = 12
FULL = 1 << SCALE
#: Pairs of ids that occur less often in a frame are left to order 0.
LEAST_PAIR = 4
MOST_BITS = 12
ESCAPE = 65535
_SCALE = np.uint64(SCALE)
_32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
_FIELD = 20
_WIDTH = (1 << _FIELD) - 1


def _squash() -> np.ndarray:
    """Logistic of -2047..2047 (in 1/256) as a probability of FULL."""
    x = np.arange(-2047, 2048) / 256.0
    return np.clip(np.rint(FULL / (1 + np.exp(-x))), 16, FULL - 16).astype(np.int32)


SQUASH = _squash()
STRETCH = np.clip(np.searchsorted(SQUASH, np.arange(FULL)) - 2047, -2047, 2047).astype(np.int32)
#: SQUASH of any sum of weighted stretched chances; numbers below 0 count from the end.
_MOST = 32768
SQUASHED = np.concatenate([SQUASH[2047:], np.full(_MOST - 2048, SQUASH[-1]), np.full(_MOST - 2047, SQUASH[0]), SQUASH[:2047]]).astype(np.int32)
#: What a seen id's record, 0 to 7, changes by: after another id, and after the same.
MOVED = np.array([-1 - (t >> 1) for t in range(8)] + [int(t < 7) for t in range(8)], np.int32)


def _log2(n: np.ndarray) -> np.ndarray:
    """Bits of n - 1, that is the least b with 2^b >= n."""
    return np.frexp(np.maximum(n - 1, 0).astype(np.float64))[1].astype(np.int64)


def _coarse(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each: their highest four bits and how far these are shifted."""
    shift = np.maximum(np.frexp(n.astype(np.float64))[1] - 4, 0)
    return ((n >> shift) + 8 * shift).astype(np.uint8)


def _fine(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    shift = np.maximum(code // 8 - 1, 0)
    return (code - 8 * shift) << shift


def _packed(values: np.ndarray, kind: str) -> bytes:
    """An array's bytes, all lowest ones first, compressed; its length and theirs before them."""
    data = zlib.compress(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes(), 6)
    return struct.pack("<II", len(values), len(data)) + data


def _unpacked(data: memoryview, at: int, kind: str) -> tuple[np.ndarray, int]:
    n, size = struct.unpack_from("<II", data, at)
    at += 8
    raw = np.frombuffer(zlib.decompress(data[at : at + size]), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel().astype(np.int64), at + size


def _shares(row: np.ndarray, rows: int, counts: np.ndarray, totals: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widths of symbols within 2^bits of their row, and each row's width that is left for its escape."""
    n, kept = np.bincount(row, minlength=rows), np.bincount(row, counts, rows).astype(np.int64)
    size = np.int64(1) << bits
    escape = np.minimum(np.maximum(1, (totals - kept) * size // np.maximum(totals, 1)), size - 2 * n)
    spare = size - escape - n
    width = 1 + counts * spare[row] // np.maximum(kept, 1)[row]
    return width, size - np.bincount(row, width, rows).astype(np.int64)


class Frequencies:
    """Order 0 and order 1 of a frame. Row 0 is order 0, the others are ids whose followers are known.

    of: the row of each id (0 without one); bits: the row's width is 2^bits; entries: id, begin and width of each id
    of each row, packed, the escape last.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, contexts: np.ndarray, followers: np.ndarray, after: np.ndarray, pairs: np.ndarray):
        """ids with their counts; contexts with their numbers of followers; the followers (after) with their counts (pairs)."""
        rows = 1 + len(contexts)
        seen = np.zeros(ESCAPE + 1, np.int64)
        seen[ids] = counts
        totals = np.concatenate([[0], np.maximum(seen[contexts], np.bincount(np.repeat(np.arange(len(contexts)), followers), pairs, len(contexts)).astype(np.int64))])
        row = np.concatenate([np.zeros(len(ids), np.int64), np.repeat(np.arange(1, rows), followers)])
        symbols, counts = np.concatenate([ids, after]), np.concatenate([counts, pairs])
        n = np.bincount(row, minlength=rows)
        self.bits = np.maximum(np.clip(_log2(totals) + 1, 4, MOST_BITS), _log2(n + 1) + 2)
        self.bits[0] = max(16, int(self.bits[0]))
        totals[0] = int(counts[: len(ids)].sum())
        width, escape = _shares(row, rows, counts, totals, self.bits)
        ends = np.cumsum(n)
        symbols, width = np.insert(symbols, ends, ESCAPE), np.insert(width, ends, escape)
        self.base = np.cumsum(np.int64(1) << self.bits) - (np.int64(1) << self.bits)
        begin = np.cumsum(width) - width
        begin -= np.repeat(self.base, n + 1)
        self.entries = symbols << (2 * _FIELD) | begin << _FIELD | width
        self.escapes = ends + np.arange(rows)
        self.of = np.zeros(ESCAPE + 1, np.intp)
        self.of[contexts] = np.arange(1, rows)
        self.ids = ids

    def slots(self) -> np.ndarray:
        """The entry of each place of each row's width."""
        return np.repeat(np.arange(len(self.entries), dtype=np.int32), self.entries & _WIDTH)


def _runs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return first, np.diff(np.concatenate([first, [len(pairs)]]))


def measured(ids: np.ndarray) -> tuple[bytes, Frequencies, np.ndarray]:
    """The stored form of a frame's frequencies, the frequencies, and the entry of each of its ids."""
    seen = np.bincount(ids)
    known = np.flatnonzero(seen)
    pairs = np.empty(len(ids), np.int64)  # the id before, the id and the place, in this order of weight; sorted in its place
    pairs[1:] = ids[:-1]
    pairs[::BLOCK] = ESCAPE
    pairs <<= 16
    pairs |= ids
    pairs <<= 31
    pairs |= np.arange(len(ids), dtype=np.int32)
    pairs.sort()
    place = (pairs & 0x7FFFFFFF).astype(np.int32)
    pairs >>= 31
    first, count = _runs(pairs)
    pair = pairs[first]
    del pairs
    kept = (count >= LEAST_PAIR) & (pair >> 16 != ESCAPE)
    context, after, codes = pair[kept] >> 16, pair[kept] & 0xFFFF, _coarse(count[kept])
    start, followers = _runs(context) if len(context) else (np.empty(0, np.int64), np.empty(0, np.int64))
    contexts = context[start]
    steps = np.diff(after, prepend=0)
    steps[start] = after[start]
    stored = b"".join([
        _packed(np.diff(known, prepend=0), "<u2"), _packed(seen[known], "<u4"),
        _packed(np.diff(contexts, prepend=0), "<u2"), _packed(followers, "<u2"), _packed(steps, "<u2"), _packed(codes, "<u1"),
    ])
    found = Frequencies(known, seen[known], contexts, followers, after, _fine(codes))
    row = found.of[pair >> 16]
    entry = np.where(row > 0, found.escapes[row], -1)
    entry[kept] = len(known) + 1 + np.arange(len(context)) + np.repeat(np.arange(len(contexts)), followers)
    own = np.empty(len(ids), np.int32)
    own[place] = np.repeat(entry.astype(np.int32), count)
    alone = np.flatnonzero(own < 0)
    own[alone] = np.searchsorted(known, ids[alone])
    return stored, found, own


def stored_frequencies(data: memoryview) -> Frequencies:
    at, parts = 0, []
    for kind in ("<u2", "<u4", "<u2", "<u2", "<u2", "<u1"):
        part, at = _unpacked(data, at, kind)
        parts.append(part)
    ids, counts, contexts, followers, steps, codes = parts
    after = np.cumsum(steps)
    starts = np.cumsum(followers) - followers
    if len(after):
        after -= np.repeat(after[starts] - steps[starts], followers)
    return Frequencies(np.cumsum(ids), counts, np.cumsum(contexts), followers, after, _fine(codes))


class Model:
    """The order-2 predictions of all lanes, and the chances that they come true: by their record and by the latest outcomes."""

    def __init__(self, lanes: int):
        each = np.arange(lanes, dtype=np.int32)
        self.table = np.zeros(lanes << TABLE_BITS, np.int32)
        self.base = each << TABLE_BITS
        self.chance = np.full(2 * lanes * 16, FULL // 8, np.int32)
        self.base16 = np.stack([each, each + lanes]).astype(np.intp) * 16
        self.weights = np.full((2, lanes), 33_000, np.int32)
        self.mixed = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)
        self.history = np.zeros(lanes, np.int32)
        self.steps = 0

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id and the probability (of FULL) that it comes, for the first k lanes."""
        at = self.mixed[:k] & ((1 << TABLE_BITS) - 1)
        at += self.base[:k]
        at = at.astype(np.intp)  # numpy converts other indices at each use
        q = self.table[at]
        trust = q & 7
        place = self.base16[:, :k].copy()
        place[0] += trust
        place[1] += self.history[:k]
        old = self.chance[place]
        x = STRETCH[old.astype(np.intp)]
        total = self.weights[:, :k] * x
        total[0] += total[1]
        p = SQUASHED[(total[0] >> 16).astype(np.intp)]  # from the end where it is below 0
        self.state = at, q, trust, place, old, x, p
        return q >> 3, p

    def learn(self, ids: np.ndarray, hit: np.ndarray, k: int) -> None:
        at, q, trust, place, old, x, p = self.state
        target = hit.astype(np.int32)
        recent = self.history[:k]
        recent += recent
        recent += target
        recent &= 15
        trust += target << 3
        target <<= SCALE
        x *= target - p
        x >>= 10
        weights = self.weights[:, :k]
        weights += x
        self.steps += 1
        if not self.steps % 16:  # 16 steps move a weight by less than 150,000
            np.minimum(weights, 150_000, out=weights)
            np.maximum(weights, -150_000, out=weights)
        target = target - old
        target >>= 4
        target += old
        self.chance[place] = target
        q += MOVED[trust.astype(np.intp)]
        self.table[at] = np.where(trust < 2, ids << 3 | 1, q)
        mixed = self.before[:k] * np.int32(30011)
        mixed += ids * np.int32(40503)
        mixed ^= mixed >> 15
        self.mixed[:k] = mixed
        self.before[:k] = ids


def _normalised(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, low, range) after a shift by 32 bits of lanes whose range is under 2^32."""
    apart = ((low ^ (low + rng - np.uint64(1))) >> _32) != 0
    rng = np.where(apart, (~low + np.uint64(1)) & _LOW32, rng)
    return (low >> _32).astype(np.uint32), low << _32, rng << _32


def _columns(values: np.ndarray, lanes: int, most: int) -> np.ndarray:
    """A frame's values with one row a step and one column a lane."""
    padded = np.zeros(lanes * most, values.dtype)
    padded[: len(values)] = values
    return np.ascontiguousarray(padded.reshape(lanes, most).T)


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """A frame's stored frequencies and the coded bytes of each of its blocks."""
    if not len(ids):
        return b"", []
    stored, found, entry = measured(ids)
    lanes, most = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    last = len(ids) - (lanes - 1) * BLOCK
    columns, entry = _columns(ids.astype(np.int32, copy=False), lanes, most), _columns(entry, lanes, most)
    entries, bits, of = found.entries, found.bits.astype(np.uint64), found.of
    begins, widths = (entries >> _FIELD & _WIDTH).astype(np.uint64), (entries & _WIDTH).astype(np.uint64)
    bits0, is_escape = bits[0], entries >> (2 * _FIELD) == ESCAPE
    model = Model(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words = np.zeros((lanes, most + most // 2 + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    row = np.zeros(lanes, np.intp)

    def shift(at: np.ndarray) -> None:
        word, low[at], rng[at] = _normalised(low[at], rng[at])
        words[at, used[at]] = word
        used[at] += 1

    for t in range(most):
        k = lanes if t < last else lanes - 1
        own, mine = columns[t, :k], entry[t, :k].astype(np.intp)
        guess, p = model.predict(k)
        hit = own == guess
        begin, width = begins[mine], widths[mine]
        all_of = rng[:k]
        split = (all_of >> _SCALE) * p.astype(np.uint64)
        r = (all_of - split) >> bits[row[:k]]
        begin *= r
        begin += split
        begin *= ~hit
        low[:k] += begin
        width *= r
        rng[:k] = np.where(hit, split, width)
        short = np.flatnonzero(rng[:k] <= _LOW32)
        if len(short):
            shift(short)
        odd = np.flatnonzero(is_escape[mine] & ~hit)
        if len(odd):
            e = np.searchsorted(found.ids, own[odd])
            r = rng[odd] >> bits0
            low[odd] += r * begins[e]
            rng[odd] = r * widths[e]
            short = odd[rng[odd] <= _LOW32]
            if len(short):
                shift(short)
        model.learn(own, hit, k)
        row[:k] = of[own.astype(np.intp)]
    tail = np.stack([low >> _32, low & _LOW32], axis=1).astype("<u4")
    return stored, [words[i, :n].astype("<u4").tobytes() + tail[i].tobytes() for i, n in enumerate(used.tolist())]


def decode(stored: memoryview, coded: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of a frame."""
    if not n_ids:
        return np.empty(0, np.int32)
    found = stored_frequencies(stored)
    lanes, most = len(coded), min(BLOCK, n_ids)
    last = n_ids - (lanes - 1) * BLOCK
    parts = [np.frombuffer(c, "<u4") for c in coded]
    words = np.zeros((lanes, max(map(len, parts)) + 2), np.uint32)
    for lane, part in enumerate(parts):
        words[lane, : len(part)] = part
    slots, base, entries, of = found.slots(), found.base, found.entries, found.of
    bits = found.bits.astype(np.uint64)
    tops = (np.uint64(1) << bits) - np.uint64(1)
    symbols = (entries >> (2 * _FIELD)).astype(np.int32)
    begins, widths = (entries >> _FIELD & _WIDTH).astype(np.uint64), (entries & _WIDTH).astype(np.uint64)
    model = Model(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = words[:, 0].astype(np.uint64) << _32 | words[:, 1]
    used = np.full(lanes, 2, np.int64)
    row = np.zeros(lanes, np.intp)
    columns = np.zeros((most, lanes), np.int32)

    def shift(at: np.ndarray) -> None:
        _, low[at], rng[at] = _normalised(low[at], rng[at])
        code[at] = code[at] << _32 | words[at, used[at]]
        used[at] += 1

    for t in range(most):
        k = lanes if t < last else lanes - 1
        guess, p = model.predict(k)
        all_of, mine = rng[:k], row[:k]
        split = (all_of >> _SCALE) * p.astype(np.uint64)
        ahead = code[:k] - low[:k]
        hit = ahead < split
        r = (all_of - split) >> bits[mine]
        ahead -= split
        ahead //= r
        slot = np.minimum(ahead, tops[mine]).astype(np.int64)  # of no account where the prediction holds
        slot += base[mine]
        e = slots[slot].astype(np.intp)
        own = np.where(hit, guess, symbols[e])
        begin = begins[e]
        begin *= r
        begin += split
        begin *= ~hit
        low[:k] += begin
        rng[:k] = np.where(hit, split, widths[e] * r)
        short = np.flatnonzero(rng[:k] <= _LOW32)
        if len(short):
            shift(short)
        odd = np.flatnonzero(own == ESCAPE)
        if len(odd):
            r = rng[odd] >> bits[0]
            e = slots[np.minimum((code[odd] - low[odd]) // r, tops[0]).astype(np.int64)]
            own[odd] = symbols[e]
            low[odd] += r * begins[e]
            rng[odd] = r * widths[e]
            short = odd[rng[odd] <= _LOW32]
            if len(short):
                shift(short)
        columns[t, :k] = own
        model.learn(own, hit, k)
        row[:k] = of[own.astype(np.intp)]
    return columns.T.ravel()[:n_ids]
