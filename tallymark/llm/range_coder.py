"""Op 1's codec: an adaptive context-mixing range coder over token ids, run over many blocks in step.

The chance of the next id x is a mixture of three predictions:

    P(x) = w2 [x is the id order 2 expects] + w1 [x is the id order 1 expects] + w0 P0(x)

Order 2 and order 1 remember the id that last followed the last two ids or the last id, and how well that held; order 0, P0,
is the distribution of ids in the shard, which the shard's head carries. The weights adapt: each pair of confidences, and
whether both orders expect the same id, has its own, moved towards what turned out right. One step of the range coder codes an id
whole, by its share of the mixture. All arithmetic is on integers, so encoder and decoder agree on any machine.

Blocks start from empty orders 2 and 1 and from the same weights, so each is decoded alone (with the head), and each has a
checksum. Blocks are the lanes of numpy vectors: each step handles one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MOST_IDS = 1 << 16
_BITS = 20  # frequencies of order 0 sum to 2**20
_SLOTS = 2048  # of each context table
_PART, _PART_MASK = np.uint64(21), np.uint64((1 << 21) - 1)
_ONE, _MOST = 4096, 4032  # weights sum to _ONE, and orders 2 and 1 get _MOST at most


def head(ids: np.ndarray) -> bytes:
    """Order 0: the ids that occur and their frequencies out of 2**20, each 1 at least, as deltas and numbers under zlib."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < MOST_IDS:
        raise ValueError(f"ids must be from 0 to {MOST_IDS - 1}")
    counts = np.bincount(ids, minlength=1)
    used = np.flatnonzero(counts)
    room = (1 << _BITS) - len(used)
    share = np.cumsum(counts[used]) * room // max(int(counts.sum()), 1)
    freq = np.diff(share, prepend=0) + 1
    return zlib.compress(struct.pack("<I", len(used)) + np.diff(used, prepend=0).astype("<u2").tobytes() + freq.astype("<u4").tobytes(), 9)


class _Order0:
    def __init__(self, data: bytes):
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        used = np.cumsum(np.frombuffer(raw, "<u2", n, 4).astype(np.int64))
        freq = np.frombuffer(raw, "<u4", n, 4 + 2 * n).astype(np.uint64)
        #: begin << 21 | frequency of every id; a frequency may be the whole 2**20.
        self.parts = np.zeros(MOST_IDS, np.uint64)
        self.parts[used] = (np.cumsum(freq) - freq) << _PART | freq
        self.used, self.sizes = used, freq.astype(np.int64)

    def inverse(self) -> np.ndarray:
        """The id at each place of the 2**20."""
        return np.repeat(self.used.astype(np.uint16), self.sizes)


class _Contexts:
    """The adaptive state of `n` lanes; the same calls in the same order on both sides. Row 0 is order 2, row 1 order 1."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.slots = np.stack([lane * _SLOTS, (n + lane) * _SLOTS])
        self.own = (lane * 128).astype(np.uint32)
        self.seen = np.zeros(2 * n * _SLOTS, np.uint32)  # id * 8 + confidence
        sure = np.arange(128)
        c2, c1, same = sure >> 4, sure >> 1 & 7, sure & 1
        first = np.where(c2 > 0, 256 + 420 * c2, 0)
        second = np.where((c1 > 0) & (same == 0), np.minimum(64 + 90 * c1, _MOST - first), 0)
        self.weights = np.tile((first << 16 | second).astype(np.int32), n)  # of order 2 above, of order 1 below
        self.fit(n)

    def fit(self, k: int) -> None:
        """Go on with the first k lanes. A step's arrays are made once for all steps, and casts are assignments: both cost less."""
        self.base, self.cells = self.slots[:, :k], self.own[:k]
        self.c, self.m = np.empty((2, k), np.uint32), np.empty((2, k), np.uint32)
        self.place, self.same, self.cell = np.empty(k, np.uint32), np.empty(k, np.uint32), np.empty(k, np.int64)
        self.gain, self.fade = np.empty((2, k), np.int32), np.empty(k, np.int32)

    def places(self, before: np.ndarray, last: np.ndarray, at: np.ndarray) -> None:
        """Where orders 2 and 1 keep what followed these last two ids, given as id * _HASH: into at, whose next to last axis has two rows."""
        two, one = at[..., 0, :], at[..., 1, :]
        np.right_shift(before, 6, out=two)
        two += last
        two ^= last >> 9
        one[...] = last
        at >>= 4
        at &= _SLOTS - 1
        at += self.base

    def expect(self, at: np.ndarray, entry: np.ndarray, held: np.ndarray) -> None:
        """What orders 2 and 1 expect there, with their confidence (two rows of entry), and their weights."""
        c, m, place = self.c, self.m, self.place
        entry[...] = self.seen[at]
        np.bitwise_and(entry, 7, out=c)
        np.multiply(c, _PLACE, out=m)
        np.add(m[0], m[1], out=place)
        place += self.cells
        np.bitwise_xor(entry[0], entry[1], out=self.same)
        self.same[...] = self.same < 8
        place += self.same
        self.cell[...] = place
        held[...] = self.weights.take(self.cell)

    def learn(self, at: np.ndarray, entry: np.ndarray, held: np.ndarray, x8: np.ndarray, hit: np.ndarray) -> None:
        """x8: the ids that came, times 8. hit: gets whether they were expected."""
        c, m, gain, fade = self.c, self.m, self.gain, self.fade
        np.bitwise_xor(entry, x8, out=m)  # the confidence of a hit, 8 + the confidence of a miss at least
        np.less(m, 8, out=hit)
        c |= 8
        np.minimum(m, c, out=m)
        step = _STEP.take(m)
        self.seen[at] = np.where(step == _NEW, x8 + _FIRST, entry + step)
        # Both weights at once: each loses a 32nd, rounded up, and the one that was right gets a 32nd of _MOST.
        np.add(held, _ROUND, out=fade)
        fade >>= 5
        fade &= _BOTH
        np.subtract(held, fade, out=fade)
        gain[0] = hit[0]
        gain[1] = hit[1] > hit[0]
        gain *= _GAINS
        fade += gain[0]
        fade += gain[1]
        self.weights[self.cell] = fade


_HASH = 40_503
#: By confidence of a hit, then by confidence of a miss: what is added to an entry, or _NEW where it goes to the new id.
_NEW, _FIRST = np.uint32(2**32 - 100), np.uint32(1)
_STEP = np.array([*[1] * 7, 0, int(_NEW), int(_NEW), *(2**32 - (c + 1 >> 1) for c in range(2, 8))], np.uint32)
_PLACE = np.array([[16], [2]], np.uint32)
_GAINS = np.array([[_MOST >> 5 << 16], [_MOST >> 5]], np.int32)
_ROUND, _BOTH = np.int32(31 << 16 | 31), np.int32(0x07FF07FF)
_FULL, _WIDE, _LEAST, _TWICE = np.uint64(16), np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(1 << 32)
_TOP = np.uint64(48)


class _Coder:
    """The interval of each lane: 64-bit low end and width, put out or taken in by 16 bits."""

    def __init__(self, n: int):
        self.lows, self.widths = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
        self.fit(n)

    def fit(self, k: int) -> None:
        """Go on with the first k lanes."""
        self.low, self.width = self.lows[:k], self.widths[:k]
        self.unit, self.u0, self.by, self.high = (np.empty(k, np.uint64) for _ in range(4))
        self.sum = np.empty((2, k), np.uint64)

    def units(self, w0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The width of one of the weights' 4,096 parts, and of one of order 0's 2**20 parts, whose weight is w0."""
        np.right_shift(self.width, _TWELVE, out=self.unit)
        np.multiply(self.unit, w0, out=self.u0)
        self.u0 >>= _TWENTY
        return self.unit, self.u0

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> None:
        """Go on with the part of this begin and size."""
        low, width, high, by = self.low, self.width, self.high, self.by
        low += begin
        width[...] = size
        # Put out 16 bits where they are settled; where the interval is small yet straddles them, cut it off at the border.
        np.add(low, width, out=high)
        high ^= low
        settled, small = high < _WIDE, width < _LEAST
        cut = (small > settled).nonzero()[0]
        if len(cut):
            width[cut] = _to_border(low.take(cut))
        again = (width < _TWICE).nonzero()[0]  # no other lane can need more than one round
        settled |= small
        self.shift(settled.nonzero()[0])
        by[...] = settled
        by <<= _FOUR
        low <<= by
        width <<= by
        while len(again):
            l, w = low.take(again), width.take(again)
            open_ = (l ^ (l + w)) >= _WIDE
            need = (~open_ | (w < _LEAST)).nonzero()[0]
            again, l, w = again.take(need), l.take(need), w.take(need)
            w = np.where(open_.take(need), _to_border(l), w)
            self.shift(again)
            low[again], width[again] = l << _FULL, w << _FULL
            again = again.take((w < _TWICE).nonzero()[0])


def _to_border(low: np.ndarray) -> np.ndarray:
    return (~low + _ONCE) & (_LEAST - _ONCE)


class _Encoder(_Coder):
    def __init__(self, n: int):
        super().__init__(n)
        self.lanes, self.words = [], []
        self.kind = np.uint16 if n <= 1 << 16 else np.int32

    def shift(self, lanes) -> None:
        self.lanes.append(lanes.astype(self.kind))
        self.words.append((self.low.take(lanes) >> _TOP).astype(np.uint16))

    def done(self) -> list[bytes]:
        """Each lane's words: what it put out, and its low end."""
        self.fit(len(self.lows))
        for _ in range(4):
            self.shift(np.arange(len(self.low)))
            self.low <<= _FULL
        lanes = np.concatenate(self.lanes)
        words = np.concatenate(self.words)[np.argsort(lanes, kind="stable")].astype("<u2")
        ends = np.cumsum(np.bincount(lanes, minlength=len(self.low))).tolist()
        return [words[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


class _Decoder(_Coder):
    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        self.room = max(map(len, payloads)) // 2 + 8
        self.data = np.zeros(n * self.room, np.uint16)
        for i, p in enumerate(payloads):
            self.data[i * self.room : i * self.room + len(p) // 2] = np.frombuffer(p, "<u2")
        self.at = np.arange(n) * self.room
        self.places = np.zeros(n, np.uint64)  # of the code above the low end
        super().__init__(n)
        for _ in range(4):
            self.shift(np.arange(n))

    def fit(self, k: int) -> None:
        super().fit(k)
        self.place = self.places[:k]

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> None:
        self.place -= begin
        super().narrow(begin, size)

    def shift(self, lanes) -> None:
        at = self.at.take(lanes)
        self.place[lanes] = self.place.take(lanes) << _FULL | self.data.take(at)
        at += 1
        self.at[lanes] = at


_ONCE, _FOUR, _TWELVE, _TWENTY = np.uint64(1), np.uint64(4), np.uint64(12), np.uint64(_BITS)
_WHOLE = np.uint64(_ONE)
_STEPS = 32  # of all lanes, encoded at once as far as they don't depend on each other


def encode(ids: np.ndarray, first: bytes, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """Blocks of the ids, in order: number of ids, their crc32 as little-endian u32, payload. first: the head of these ids."""
    total = len(ids)
    n = -(-total // block)
    if not n:
        return []
    zero = _Order0(first)
    lens = np.minimum(block, total - np.arange(n) * block)  # only the last is shorter, so active lanes are a prefix
    grid = np.zeros(n * block, np.int32)
    grid[:total] = ids
    grid = np.concatenate([np.zeros((2, n), np.int32), grid.reshape(n, block).T])
    m, c = _Contexts(n), _Encoder(n)
    short = int(lens[-1])
    edges = [*range(0, short, _STEPS), *range(short, block if n > 1 else short, _STEPS), block if n > 1 else short]
    for a, b in zip(edges, edges[1:], strict=False):
        k = n if b <= short else n - 1
        if a == short:
            m.fit(k)
            c.fit(k)
        x = grid[a + 2 : b + 2, :k]
        x8 = x.astype(np.uint32) << 3
        at = np.empty((b - a, 2, k), np.int64)
        hashes = grid[a : b + 1, :k] * np.int64(_HASH)
        m.places(hashes[:-1], hashes[1:], at)
        entry, hit, held = np.empty((b - a, 2, k), np.uint32), np.empty((b - a, 2, k), bool), np.empty((b - a, k), np.int32)
        for t in range(b - a):
            m.expect(at[t], entry[t], held[t])
            m.learn(at[t], entry[t], held[t], x8[t], hit[t])
        # Begin and size of an id in its interval, in parts of order 0 and of the weights.
        part = zero.parts.take(x)
        small, large = np.empty((b - a, 2, k), np.uint64), np.empty((b - a, 2, k), np.uint64)
        np.right_shift(part, _PART, out=small[:, 0])
        np.bitwise_and(part, _PART_MASK, out=small[:, 1])
        v2, v1 = held >> 16, held & 0xFFFF
        for j, found in enumerate((entry < x8[:, None], hit)):
            found = found.astype(np.int32)
            large[:, j] = v2 * found[:, 0] + v1 * found[:, 1]
        w0 = (_ONE - v2 - v1).astype(np.uint64)
        for t in range(b - a):
            unit, u0 = c.units(w0[t])
            s = small[t]
            s *= u0
            s += np.multiply(large[t], unit, out=c.sum)
            c.narrow(s[0], s[1])
    raw = np.ascontiguousarray(ids, "<u4")
    return [(int(k), zlib.crc32(raw[i * block : i * block + k].tobytes()), p) for i, (k, p) in enumerate(zip(lens, c.done(), strict=True))]


def decode(blocks: list[tuple[int, int, bytes]], first: bytes) -> np.ndarray:
    """The ids of blocks that stand in any order of length; a wrong checksum raises."""
    if not blocks:
        return np.zeros(0, np.int64)
    zero = _Order0(first)
    inverse, final = zero.inverse(), np.uint64((1 << _BITS) - 1)
    lens = np.array([b[0] for b in blocks])
    order = np.argsort(-lens, kind="stable")
    n, longest = len(blocks), int(lens.max())
    running = np.searchsorted(-lens[order], -np.arange(longest), side="left").tolist()
    m, c = _Contexts(n), _Decoder([blocks[i][2] for i in order])
    grid = np.zeros((longest, n), np.uint16)
    before, last, now = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for t, k in enumerate(running):
        if k != now:
            now, before, last = k, before[:k], last[:k]
            m.fit(k)
            c.fit(k)
            at, entry, hit, held = np.empty((2, k), np.int64), np.empty((2, k), np.uint32), np.empty((2, k), bool), np.empty(k, np.int32)
            v, u, begin, size, lead = (np.empty((2, k), np.uint64) for _ in range(5))
            ids, x = np.empty((2, k), np.int64), np.empty(k, np.int64)
        m.places(before, last, at)
        m.expect(at, entry, held)
        v[0] = held >> 16
        v[1] = held & 0xFFFF
        w0 = _WHOLE - v[0]
        w0 -= v[1]
        unit, u0 = c.units(w0)
        np.multiply(v, unit, out=u)
        # Where the expected ids' own parts lie: what lies beyond has their shares before it, and the rest is order 0's. Where
        # both orders expect the same id, order 1 has no share.
        ids[...] = entry
        ids >>= 3
        part = zero.parts.take(ids)
        np.right_shift(part, _PART, out=begin)
        begin *= u0
        lead[0] = ids[1] < ids[0]
        lead[1] = ids[0] < ids[1]
        lead *= u[::-1]
        begin += lead
        part &= _PART_MASK
        np.multiply(part, u0, out=size)
        size += u
        own = c.place - begin < size
        begin += size
        lead[...] = begin <= c.place
        lead *= u
        start = lead[0] + lead[1]
        left = c.place - start
        left //= u0
        np.minimum(left, final, out=left)
        x[...] = inverse.take(left.view(np.int64))
        np.copyto(x, ids[1], where=own[1])
        np.copyto(x, ids[0], where=own[0])
        part = zero.parts.take(x)
        lead[...] = own
        lead *= u
        width = part & _PART_MASK
        width *= u0
        width += lead[0]
        width += lead[1]
        part >>= _PART
        part *= u0
        start += part
        c.narrow(start, width)
        m.learn(at, entry, held, (x << 3).astype(np.uint32), hit)
        grid[t, :k] = x
        before, last = last, x * np.int64(_HASH)
    out = [None] * n
    for j, i in enumerate(order):
        out[i] = grid[: lens[i], j]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != blocks[i][1]:
            raise ValueError(f"block {i} does not match its checksum")
    return np.concatenate(out)
