"""Adaptive context-mixing range coder for blocks of token ids.

Every block is coded on its own: models start anew and decoding needs nothing
else. Blocks are lanes: one step codes the next id of all blocks at once, with
integer arithmetic only, so that every machine decodes alike.

Within a block ids are numbered in the order in which they first appear; the ids
of these numbers stand before the coded words, in as many bits each as the
block's greatest id has. The next number is predicted by order 2 (what followed
the last two) and order 1 (what followed the last one). Two adaptive
probabilities, one by the order-2 prediction's confidence and one by the order-1
prediction's and whether both agree, are mixed with a weight per lane that
follows the better of them; the mix drives the coding of "the prediction holds".
If it does not, order 0 codes the number by how often it comes back in the block
without being predicted; a number that is new has the share of all new ones. The
encoder predicts the whole block first and counts then. The counts stand before
the ids in unary, so that the decoder finds a number by one look at a table.

A block has one coded stream of what held and what didn't, and WAYS streams that
share its numbers of order 0: these need no prediction, so that all are decoded
before, WAYS lanes for each block. A coder keeps 48 bits of low and range and
writes 16-bit words; carries are added to the words at the end.
"""

from __future__ import annotations

import struct
from itertools import accumulate

import numpy as np

#: Ids of a block; the greatest id.
BLOCK, MAX_ID = 2048, (1 << 32) - 1
#: Streams that share a block's numbers of order 0.
WAYS = 4
_U = np.uint64
_16, _32 = _U(16), _U(32)
_SMALL, _REST = _U(1 << 32), _U((1 << 32) - 1)
_LOW, _HIGH = np.uint32(0xFFFF), np.uint32(16)
_HEAD = struct.Struct(f"<BHH{WAYS}H")  # bits of an id, distinct ids, sum of the counts, words of all streams but the last
_LEAST = np.int32(48)  # probability, of 2**16
_DIRECT = 1 << 22  # greatest id whose first place is looked up in a table


def numbered(ids: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers by first appearance, and the id of each number. ``table`` has room for every id, whatever is in it."""
    if not len(ids):
        return np.zeros(0, np.int64), ids
    keys, at = ids, np.arange(len(ids))
    if table is None or int(ids.max()) >= len(table):
        keys = np.unique(ids, return_inverse=True)[1]
        table = np.empty(len(ids), np.int64)
    keys = keys.astype(np.int64)
    table[keys[::-1]] = at[::-1]  # the last write is the first place
    place = table[keys]
    fresh = place == at
    return (np.cumsum(fresh) - 1)[place], ids[fresh]


def _packed(ids: np.ndarray) -> tuple[int, bytes]:
    """Bits of an id, and all ids in so many bits each."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 16:
        return bits, ids.astype(">u2").tobytes()
    grid = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return bits, np.packbits(grid).tobytes()


def _unpacked(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", count).astype(np.uint32)
    grid = np.zeros((count, 32), np.uint8)
    grid[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count).reshape(count, bits)
    return np.packbits(grid, axis=1).view(">u4").ravel().astype(np.uint32)


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The context of two numbers."""
    return before * np.int16(709) + after & np.int16(BLOCK - 1)


class _Models:
    """The adaptive state of all lanes; the first ``m`` lanes are in use. Numbers count from 1 here, 0 is none. Rows of two are order 1 and order 2."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.base = np.stack([lane * (BLOCK + 1), lanes * (BLOCK + 1) + lane * BLOCK])
        self.seen = np.zeros(lanes * (2 * BLOCK + 1), np.int16)  # number * 4 + confidence
        self.cell = np.stack([lane * 12, lane * 12 + 8])  # order 1: by confidence and whether both agree; order 2: by confidence
        self.chance = np.full(lanes * 12, 1 << 13, np.int32)  # of 2**16
        self.weight = np.full(lanes, 1 << 13, np.int32)  # of order 2, of 2**14

    def predict(self, m: int, context: np.ndarray) -> np.ndarray:
        """Probability, of 2**16, that ``self.guess`` follows, by the last number and by the pair's hash."""
        self.at = self.base[:, :m] + context
        entry = self.seen.take(self.at, mode="clip")
        self.number, self.sure = entry >> 2, entry & 3
        one, two = self.number
        self.guess = np.where(two > 0, two, one)
        self.cells = self.cell[:, :m] + self.sure
        self.cells[0] += (one == self.guess) * 4
        self.odds = self.chance.take(self.cells, mode="clip")
        one, two = self.odds
        p = two - one
        p *= self.weight[:m]
        p >>= 14
        p += one
        return p

    def learn(self, m: int, numbers: np.ndarray, hit: np.ndarray) -> None:
        """What the numbers of this step change in the predictions."""
        goal = hit * np.int32(65536 - 2 * _LEAST)
        goal += _LEAST
        gap = goal - self.odds
        self.chance[self.cells] = self.odds + (gap >> 4)
        one, two = np.abs(gap, out=gap)
        w = one - two
        w >>= 7
        w += self.weight[:m]
        np.minimum(np.maximum(w, 512, out=w), (1 << 14) - 512, out=self.weight[:m])
        sure = np.minimum(self.sure, 2, out=self.sure)
        sure *= self.number == numbers
        sure += (numbers << 2) + np.int16(1)
        self.seen[self.at] = sure


class _Writer:
    """A range coder for each lane. A lane may narrow its range by up to 2**11 twice before it is settled."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.span = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
        self.out, self.start = np.zeros((lanes, steps + 4), np.uint32), np.arange(lanes) * (steps + 4)
        self.at, self.flat = self.start.copy(), self.out.reshape(-1)

    def settle(self, m: int) -> None:
        """Write words until the range of each of the first ``m`` lanes has 32 bits again."""
        lanes = np.flatnonzero(self.span[:m] < _SMALL)
        while len(lanes):
            low, span, at = self.low.take(lanes), self.span.take(lanes) << _16, self.at.take(lanes)
            self.flat[at] = low >> _32  # with its carry
            self.at[lanes] = at + 1
            self.low[lanes], self.span[lanes] = (low & _REST) << _16, span
            lanes = lanes[span < _SMALL]

    def words(self) -> list[bytes]:
        """What the lanes have written, up to a word that lies in their last range; zeros follow."""
        self.settle(len(self.span))
        self.flat[self.at] = self.low + _REST >> _32
        used = self.at - self.start + 1
        out = self.out[:, : used.max()]
        while (over := out >> _HIGH).any():
            out &= _LOW
            out[:, :-1] += over[:, 1:]
        return [row[:u].tobytes() for row, u in zip(out.astype("<u2"), used.tolist())]


class _Reader:
    """The lanes of a ``_Writer``, by what is left of the code above the range's low end."""

    def __init__(self, parts: list[bytes]) -> None:
        row = max(map(len, parts)) // 2 + 4
        words = np.frombuffer(b"".join(p.ljust(2 * row, b"\0") for p in parts), "<u2").astype(_U)
        self.at, self.words = np.arange(len(parts)) * row + 3, words
        self.code, self.span = words[self.at - 3] << _32 | words[self.at - 2] << _16 | words[self.at - 1], np.full(len(parts), 1 << 48, _U)

    def settle(self, m: int) -> None:
        lanes = np.flatnonzero(self.span[:m] < _SMALL)
        while len(lanes):
            span, at = self.span.take(lanes) << _16, self.at.take(lanes)
            self.code[lanes] = self.code.take(lanes) << _16 | self.words.take(at, mode="clip")
            self.at[lanes], self.span[lanes] = at + 1, span
            lanes = lanes[span < _SMALL]


def _unary(counts: np.ndarray, known: np.ndarray) -> list[bytes]:
    """For each lane, of its ``known`` counts a zero for each of a count, and a one behind it."""
    ends = np.cumsum(counts + 1)
    stops = np.concatenate([[0], ends])[np.cumsum(known)]
    sizes = np.diff(stops, prepend=0)
    grid = np.zeros((len(known), int(sizes.max())), np.uint8)
    grid[np.repeat(np.arange(len(known)), known), ends - 1 - np.repeat(stops - sizes, known)] = 1
    return [row[: (size + 7) // 8].tobytes() for row, size in zip(np.packbits(grid, axis=1), sizes.tolist())]


def _counts(parts: list[bytes], known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The counts of all lanes, one after another, which have ``totals`` as sums."""
    row = max(map(len, parts))
    if not row:
        return np.zeros(0, np.int64)
    grid = np.unpackbits(np.frombuffer(b"".join(p.ljust(row, b"\0") for p in parts), np.uint8).reshape(len(parts), row), axis=1)
    lanes, ends = np.nonzero(grid)
    last = np.cumsum(known)[known > 0] - 1
    if not np.array_equal(np.bincount(lanes, minlength=len(parts)), known) or not np.array_equal(ends[last], (known + totals - 1)[known > 0]):
        raise ValueError("a block is damaged")
    gaps = np.diff(ends, prepend=-1) - 1
    first = (np.cumsum(known) - known)[known > 0]
    gaps[first] = ends[first]
    return gaps


def _by_lane(rows: np.ndarray, lanes: int) -> np.ndarray:
    """What WAYS streams a lane hold, step by step, in the lanes' order."""
    return rows.reshape(len(rows), lanes, WAYS).transpose(1, 0, 2).reshape(lanes, -1)


def _by_step(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.reshape(len(rows), -1, WAYS).transpose(1, 0, 2)).reshape(-1, len(rows) * WAYS)


def _active(sizes: np.ndarray, steps: int) -> list[int]:
    """For each step the number of lanes, of falling sizes, that have it."""
    return np.searchsorted(-sizes, -np.arange(steps), "left").tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of at most BLOCK ids, in order."""
    n = len(blocks)
    if not n:
        return []
    greatest = [int(b.max()) if len(b) else 0 for b in blocks]
    if max(greatest) > MAX_ID or any(len(b) and int(b.min()) < 0 for b in blocks if b.dtype.kind != "u"):
        raise ValueError(f"ids are integers from 0 to {MAX_ID}")
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    steps, distinct, table = int(sizes.max()), [], np.empty(min(max(greatest), _DIRECT) + 1, np.int64)
    own = np.zeros((n, steps + 2), np.int16)  # numbers from 1; none goes before the first two
    for lane, i in enumerate(order):
        number, ids = numbered(blocks[i], table)
        own[lane, 2 : sizes[lane] + 2] = number + 1
        distinct.append(ids)
    numbers = np.ascontiguousarray(own[:, 1:].T)
    contexts = np.stack([numbers[:-1], _pair(own[:, :-2], own[:, 1:-1]).T], axis=1)
    models, active, coder = _Models(n), _active(sizes, steps), _Writer(n, steps)
    low, span, missed = coder.low, coder.span, np.zeros((steps, n), bool)
    for t, m in enumerate(active):
        now, x, bound = numbers[t + 1, :m], span[:m], span[:m] >> _16
        bound *= models.predict(m, contexts[t, :, :m]).astype(_U)
        miss = np.not_equal(models.guess, now, out=missed[t, :m])
        hit = ~miss
        models.learn(m, now, hit)
        low[:m] += bound * miss
        span[:m] = np.where(hit, bound, x - bound)
        if t & 1:
            coder.settle(m)
    flags, missed = coder.words(), np.ascontiguousarray(missed.T)
    # order 0: lanes by falling numbers of misses; what a stream lacks of its last step narrows nothing
    many, widths = np.count_nonzero(missed, axis=1), []
    by_many = np.argsort(-many, kind="stable")
    rank, rows = np.empty(n, np.int64), -(-int(many.max()) // WAYS)
    rank[by_many] = np.arange(n)
    start, width = np.zeros((n, rows * WAYS), np.uint16), np.empty((n, rows * WAYS), np.uint16)
    width[:] = many[by_many, None]
    for lane, size in enumerate(sizes.tolist()):
        number = own[lane, 2 : size + 2][missed[lane, :size]]
        most = np.maximum.accumulate(number)
        number[1:][most[1:] > most[:-1]] = 0  # new ones, none of which is predicted
        number[:1] = 0
        count = np.bincount(number, minlength=len(distinct[lane]) + 1)
        start[rank[lane], : len(number)], width[rank[lane], : len(number)] = (np.cumsum(count) - count).take(number), count.take(number)
        widths.append(count[1:])
    start, width, whole = _by_step(start), _by_step(width), np.repeat(np.maximum(many[by_many], 1).astype(_U), WAYS)
    coder = _Writer(n * WAYS, rows)
    low, span = coder.low, coder.span
    for t, m in enumerate(_active(-(-many[by_many] // WAYS), rows)):
        m *= WAYS
        r = span[:m] // whole[:m]
        low[:m] += r * start[t, :m]
        np.multiply(r, width[t, :m], out=span[:m])
        if t & 1:
            coder.settle(m)
    ways = coder.words()
    unary = _unary(np.concatenate(widths), np.array([len(d) for d in distinct]))
    result: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        bits, ids = _packed(distinct[lane])
        streams = [flags[lane], *ways[rank[lane] * WAYS : (rank[lane] + 1) * WAYS]]
        total = int(many[lane]) - len(distinct[lane])
        result[i] = _HEAD.pack(bits, len(distinct[lane]), total, *(len(s) // 2 for s in streams[:-1])) + unary[lane] + ids + b"".join(streams)
    return result


def decode(coded: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of each block, given how many it has."""
    n = len(coded)
    if not n:
        return []
    order = np.argsort([-c for c in counts], kind="stable")
    sizes = np.array([counts[i] for i in order], np.int64)
    flags, ways, distinct, unary, many, total = [], [], [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lane, i in enumerate(order):
        bits, many[lane], total[lane], *words = _HEAD.unpack_from(coded[i]) if len(coded[i]) >= _HEAD.size else (33, 0, 0)
        at = _HEAD.size + int(many[lane] + total[lane] + 7) // 8
        stop = at + (bits * int(many[lane]) + 7) // 8
        cuts = [stop + 2 * w for w in accumulate(words, initial=0)] + [len(coded[i])]
        if many[lane] + total[lane] > counts[i] or bits > 32 or (many[lane] == 0) != (counts[i] == 0) or cuts[-2] > cuts[-1] or (cuts[-1] - stop) % 2:
            raise ValueError("a block is damaged")
        unary.append(coded[i][_HEAD.size : at])
        distinct.append(_unpacked(coded[i][at:stop], bits, int(many[lane])))
        first, *others = (coded[i][a:b] for a, b in zip(cuts, cuts[1:]))
        flags.append(first)
        ways.append(others)
    # by lane and number, 0 for new: start and count; by lane and place in order 0: number
    known, misses = many + 1, many + total
    of_number = np.cumsum(known) - known
    width = np.zeros(int(known.sum()), np.int64)
    width[of_number], old = many, np.ones(len(width), bool)
    old[of_number] = False
    width[old] = _counts(unary, many, total)
    slots = np.repeat((np.arange(len(width)) - np.repeat(of_number, known)).astype(np.int16), width)
    bounds = (np.cumsum(width) - width - np.repeat(np.cumsum(misses) - misses, known) | width << 16).astype(np.uint32)
    by_misses = np.argsort(-misses, kind="stable")
    missed = _missed([ways[i] for i in by_misses], misses[by_misses], (np.cumsum(misses) - misses)[by_misses], of_number[by_misses], slots, bounds)
    row = missed.shape[1]
    coming = np.empty(n, np.int64)  # place of the next number that isn't predicted
    coming[by_misses] = np.arange(n) * row
    missed = missed.reshape(-1)
    numbers = np.zeros((int(sizes.max()) + 2, n), np.int16)
    models, coder, context = _Models(n), _Reader(flags), np.empty((2, n), np.int16)
    code, span = coder.code, coder.span
    for t, m in enumerate(_active(sizes, len(numbers) - 2)):
        last, x, off = numbers[t + 1, :m], span[:m], code[:m]
        bound = x >> _16
        context[0, :m], context[1, :m] = last, _pair(numbers[t, :m], last)
        bound *= models.predict(m, context[:, :m]).astype(_U)
        hit = off < bound
        miss = ~hit
        span[:m] = np.where(hit, bound, x - bound)
        off -= bound * miss
        now = np.where(hit, models.guess, missed.take(coming[:m], mode="clip"))
        coming[:m] += miss
        numbers[t + 2, :m] = now
        models.learn(m, now, hit)
        if t & 1:
            coder.settle(m)
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, (i, row) in enumerate(zip(order, np.ascontiguousarray(numbers[2:].T) - 1)):
        if sizes[lane]:
            result[i] = distinct[lane].take(row[: sizes[lane]], mode="clip")
    return result


def _missed(ways: list[list[bytes]], misses: np.ndarray, of_slot: np.ndarray, of_number: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The numbers of order 0 by lane, lanes of falling ``misses``; new ones are numbered in their order."""
    n, rows = len(ways), -(-int(misses[0]) // WAYS)
    coder, values = _Reader([w for lane in ways for w in lane]), np.ones((rows, n * WAYS), np.int16)
    whole, of_slot, of_number = np.repeat(np.maximum(misses, 1).astype(_U), WAYS), np.repeat(of_slot, WAYS), np.repeat(of_number, WAYS)
    most, code, span = whole - _U(1), coder.code, coder.span
    for t, m in enumerate(_active(-(-misses // WAYS), rows)):
        m *= WAYS
        r = span[:m] // whole[:m]
        off = code[:m] // r
        np.minimum(off, most[:m], out=off)
        value = slots.take(off.astype(np.int64) + of_slot[:m], mode="clip")
        found = bounds.take(of_number[:m] + value, mode="clip")
        code[:m] -= r * (found & _LOW)
        np.multiply(r, found >> _HIGH, out=span[:m])
        values[t, :m] = value
        if t & 1:
            coder.settle(m)
    values = _by_lane(values, n)
    fresh = values == 0
    return np.where(fresh, np.minimum(np.cumsum(fresh, axis=1, dtype=np.int16), BLOCK), values) if rows else np.ones((n, 1), np.int16)
