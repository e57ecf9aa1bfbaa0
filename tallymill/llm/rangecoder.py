"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that reset the model, carry a checksum and can be read alone. Per id the
model looks up an order-2 guess (by the two ids before it) and an order-1 guess (by the one before):
the id that came there last, and whether the one before was the same. One symbol then says: the
order-2 guess, the order-1 guess, or the magnitude class of the id; in the latter case the place
inside the class follows as plain bits. The symbol's distribution mixes those of order 0 (all symbols
of the block so far) and of the context (both confidences and the class of the id before), the
latter weighing more the more often the context was seen. The distributions are made from the counts
whenever the number of ids coded has doubled, and each 512 ids, so they stay for many steps.

All blocks of a group move in step, one id each at a time: every line works on arrays over the
blocks; what needs no earlier step of the same block works on arrays over steps and blocks. Blocks
depend on nothing but their own ids, so which blocks share a group does not matter.

A block: ``CM2``, the number of ids and their CRC-32 (both little-endian, 32 bits), the code.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache
from itertools import pairwise

import numpy as np

BLOCK = 4096
MAGIC = b"CM2"
_HEAD = struct.Struct("<3sII")
MOST_ID = (1 << 17) - 5

_SYMBOLS = 32
_TOTAL_BITS = 14
_SLOTS_BITS = 10
_ROWS = 8
#: Times that the distribution of order 0 counts, against each symbol seen in the context.
_WEIGHT = np.float32(12)
#: Distributions are made anew before these steps.
_ANEW = [16, 32, 64, 128, 256, *range(512, BLOCK, 512)]
_LEAST_SPAN = np.uint64(1 << 32)
#: An entry of the table of guesses: what of the id before fits, then the id.
_ID_BITS = np.uint32(17)
_ID, _SAME = np.uint32((1 << 17) - 1), np.uint32((1 << 15) - 1)
_MIX_1, _MIX_2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_T, _UNIT, _SLOT_SHIFT = np.uint64(_TOTAL_BITS), np.uint64(32), np.uint32(32 - _SLOTS_BITS)
_TOTAL_MASK = np.uint16((1 << _TOTAL_BITS) - 1)
#: Steps that an encoder prepares at a time.
_AHEAD = 32

_values = np.arange(MOST_ID + 1, dtype=np.int64) + 4
_length = np.floor(np.log2(_values)).astype(np.int64)  # exact: the values are far below 2^53
#: Of an id: its symbol (from 2 on), the plain bits that follow, and their number.
SYMBOL_OF = (2 + 2 * (_length - 2) + ((_values >> (_length - 1)) & 1)).astype(np.int32)
BITS_OF = (_length - 1).astype(np.uint8)
PLACE_OF = (_values & ((1 << (_length - 1)) - 1)).astype(np.uint16)
#: Ids from here on are of the second class: mostly longer pieces, where those below are single bytes.
_LONGER = np.uint32(124)
#: Of a symbol and 1: the first id of its class, and the number of plain bits.
_FIRST_UPTO, _WIDTH_UPTO = np.zeros(_SYMBOLS + 1, np.uint64), np.zeros(_SYMBOLS + 1, np.uint64)
for _s in range(2, _SYMBOLS):
    _b = 2 + (_s - 2) // 2
    _FIRST_UPTO[_s + 1] = max(0, ((2 + (_s - 2) % 2) << (_b - 1)) - 4)
    _WIDTH_UPTO[_s + 1] = _b - 1
del _values, _length

_STEP = np.arange(_SYMBOLS, dtype=np.uint16)
_SHARED = np.float32((1 << _TOTAL_BITS) - _SYMBOLS)
_START = ((int(_SHARED) * _STEP.astype(np.int64)) // _SYMBOLS + _STEP).astype(np.uint16)
_ITEM = np.dtype(f"V{2 * _SYMBOLS}")  # a row as one item is read at once


class _Model:
    """The tables of ``n`` blocks: guesses (all of order 2, then all of order 1), and the symbols' distributions."""

    def __init__(self, n: int, steps: int):
        # no guess is sure at first: 1 came before 0
        self.guesses = np.full(2 * n << _SLOTS_BITS, 1 << 17, np.uint32)
        slot_of = np.arange(n) << _SLOTS_BITS
        self.slot_of = np.stack([slot_of + (n << _SLOTS_BITS), slot_of])[::-1]
        self.row_of = np.arange(n, dtype=np.int32) * _ROWS
        self.counts = np.zeros((n * _ROWS, _SYMBOLS), np.int32)
        # where the symbols' intervals start, by row; the last one's ends where all do, and so at 0 modulo that
        self.flat = np.zeros(n * _ROWS * _SYMBOLS + 1, np.uint16)
        self.starts, self.next = self.flat[:-1].reshape(-1, _SYMBOLS), self.flat[1:]
        self.starts[:] = _START
        self.as_items = self.starts.view(_ITEM).reshape(-1)
        #: Places of the symbols in the tables since the distributions were made, by step and block.
        self.seen = np.empty((min(steps, max(b - a for a, b in pairwise([0, *_ANEW, BLOCK]))), n), np.int32)

    def anew(self, steps: int, alive: int) -> None:
        """Make the distributions of the first blocks from what was seen, ``steps`` times since they were made last."""
        cells = alive * _ROWS
        counts, starts = self.counts[:cells], self.starts[:cells]
        counts += np.bincount(self.seen[:steps, :alive].ravel(), minlength=cells * _SYMBOLS).reshape(counts.shape)
        before = counts.cumsum(axis=1, dtype=np.float32)
        of_row = before[:, -1:].copy()
        before -= counts
        every = counts.reshape(alive, _ROWS, _SYMBOLS).sum(axis=1, dtype=np.int32)
        every_before = (every.cumsum(axis=1) - every).astype(np.float32)
        every_before *= _WEIGHT / every.sum(axis=1, dtype=np.int32)[:, None].astype(np.float32)
        before.reshape(alive, _ROWS, _SYMBOLS)[...] += every_before[:, None]
        of_row += _WEIGHT
        np.divide(_SHARED, of_row, out=of_row)
        before *= of_row
        np.minimum(before, _SHARED, out=before)
        starts[...] = before
        starts += _STEP


def _row(last: np.ndarray, sure_two: np.ndarray, sure_one: np.ndarray) -> np.ndarray:
    """Which of a block's rows: by the class of the id before and both confidences."""
    row = np.greater_equal(last, _LONGER).view(np.uint8)
    row += row
    row += sure_two
    row += row
    row += sure_one
    return row


def _spans(lengths: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(first step, last step, blocks alive, whether distributions are made anew first), for blocks in descending order of length."""
    longest = int(lengths[0])
    cuts = sorted({0, *lengths.tolist(), *[a for a in _ANEW if a < longest]})
    return [(a, b, int((lengths > a).sum()), a in _ANEW) for a, b in pairwise(cuts)]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of ids (each 1 to BLOCK long) to bytes."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    n, longest = len(blocks), int(lengths[0])
    # two steps of zeros come before the first id
    by_block = np.zeros((n, longest), np.uint32)
    for k, i in enumerate(order):
        by_block[k, : len(blocks[i])] = blocks[i]
    ids = np.zeros((longest + 2, n), np.uint32)
    ids[2:] = by_block.T
    del by_block
    if ids.max() > MOST_ID:
        raise ValueError(f"ids over {MOST_ID} can't be coded")
    model = _Model(n, longest)
    # an id takes at most 14 + 15 bits
    width = longest + 4
    out = np.zeros(n * width, np.uint32)
    pos = np.arange(n) * width
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    made = 0
    for begin, end, alive, anew in _spans(lengths):
        if anew:
            model.anew(begin - made, alive)
            made = begin
        lo, sp, at = low[:alive], span[:alive], pos[:alive]
        for ahead in range(begin, end, _AHEAD):
            part = ids[ahead : min(end, ahead + _AHEAD) + 2, :alive]
            now, last = part[2:], part[1:-1]
            mixed = np.empty((len(now), 2, alive), np.uint32)
            np.multiply(last, _MIX_1, out=mixed[:, 1])
            np.bitwise_xor(mixed[:, 1], part[:-2], out=mixed[:, 0])
            mixed[:, 0] *= _MIX_2
            mixed >>= _SLOT_SHIFT
            slots = mixed + model.slot_of[:, :alive]
            found = mixed
            for t in range(len(now)):
                entry, slot = found[t], slots[t]
                model.guesses.take(slot, out=entry, mode="clip")
                fresh = entry << _ID_BITS
                fresh |= now[t]
                model.guesses[slot] = fresh
            guesses = found & _ID
            sure = (found >> _ID_BITS) == (found & _SAME)
            same = guesses == now[:, None]
            either = same[:, 0] | same[:, 1]
            place = model.row_of[:alive] + _row(last, sure[:, 0], sure[:, 1])
            place *= _SYMBOLS
            symbol = SYMBOL_OF.take(now)
            symbol[either] = 1
            symbol[same[:, 0]] = 0
            place += symbol
            model.seen[ahead - made : ahead - made + len(now), :alive] = place
            lower = model.flat.take(place)
            sizes = ((model.next.take(place) - lower) & _TOTAL_MASK).astype(np.uint64)
            lowers = lower.astype(np.uint64)
            widths, places = BITS_OF.take(now), PLACE_OF.take(now)
            widths[either] = 0
            places[either] = 0
            widths, places = widths.astype(np.uint64), places.astype(np.uint64)
            upper = np.empty((len(now), alive), np.uint32)
            full, over = np.empty((2, len(now), alive), bool)
            for t in range(len(now)):
                r = sp >> _T
                add = lowers[t]
                add *= r
                r *= sizes[t]
                r >>= widths[t]
                inner = places[t]
                inner *= r
                add += inner
                lo += add
                np.less(lo, add, out=over[t])
                np.right_shift(lo, _UNIT, out=upper[t], casting="same_kind")
                shift = np.less(r, _LEAST_SPAN, out=full[t]) * _UNIT
                lo <<= shift
                np.left_shift(r, shift, out=sp)
            ats = np.cumsum(full, axis=0)
            ats += at
            at[:] = ats[-1]
            ats -= full
            out[ats[full]] = upper[full]
            # one carry at most reaches a unit
            carry = ats[over] - 1
            while len(carry):
                out[carry] += np.uint32(1)
                carry = carry[out[carry] == 0] - 1
    for shift in (32, 0):
        out[pos] = (low >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
        pos += 1
    result: list[bytes] = [b""] * n
    for k, i in enumerate(order):
        raw = np.ascontiguousarray(blocks[i], "<u4").tobytes()
        result[i] = _HEAD.pack(MAGIC, len(blocks[i]), zlib.crc32(raw)) + out[k * width : pos[k]].astype("<u4").tobytes()
    return result


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks; a block that is damaged raises."""
    if not coded:
        return []
    heads = [_HEAD.unpack_from(c) if len(c) >= _HEAD.size else (b"", 0, 0) for c in coded]
    for magic, count, _ in heads:
        if magic != MAGIC or not 0 < count <= BLOCK:
            raise ValueError("not a block of token ids")
    order = sorted(range(len(coded)), key=lambda i: -heads[i][1])
    lengths = np.array([heads[i][1] for i in order])
    n, longest = len(coded), int(lengths[0])
    width = max(len(c) for c in coded) // 4 + 4
    units = np.zeros((n, width), np.uint32)
    for k, i in enumerate(order):
        body = np.frombuffer(coded[i], "<u4", (len(coded[i]) - _HEAD.size) // 4, _HEAD.size)
        units[k, : len(body)] = body
    code = units[:, 0].astype(np.uint64) << _UNIT | units[:, 1]
    # the units of a place side by side: blocks read on at about the same pace
    units = np.ascontiguousarray(units.T).reshape(-1)
    pos = np.arange(n) + 2 * n
    span = np.full(n, (1 << 64) - 1, np.uint64)
    ids = np.zeros((longest + 2, n), np.uint32)
    model = _Model(n, longest)
    made = 0
    for begin, end, alive, anew in _spans(lengths):
        if anew:
            model.anew(begin - made, alive)
            made = begin
        co, sp, at = code[:alive], span[:alive], pos[:alive]
        slot_of, row_of, flat_of = model.slot_of[:, :alive], model.row_of[:alive], np.arange(-1, alive * _SYMBOLS - 1, _SYMBOLS)
        mixed = np.empty((2, alive), np.uint32)
        starts = np.zeros(alive * _SYMBOLS + 1, np.uint16)
        as_items, by_row, following = starts[:-1].view(_ITEM), starts[:-1].reshape(-1, _SYMBOLS), starts[1:]
        below = np.empty((alive, _SYMBOLS), bool)
        for t in range(begin, end):
            last = ids[t + 1, :alive]
            np.multiply(last, _MIX_1, out=mixed[1])
            np.bitwise_xor(mixed[1], ids[t, :alive], out=mixed[0])
            mixed[0] *= _MIX_2
            mixed >>= _SLOT_SHIFT
            slots = mixed + slot_of
            found = model.guesses.take(slots, mode="clip")
            guesses = found & _ID
            sure = (found >> _ID_BITS) == (found & _SAME)
            row = row_of + _row(last, sure[0], sure[1])
            model.as_items.take(row, out=as_items, mode="clip")
            r = sp >> _T
            value = co // r
            np.less_equal(by_row, value.astype(np.uint16)[:, None], out=below)
            # the intervals that start so far, one more than the symbol
            upto = np.bitwise_count(np.packbits(below).view(np.uint32))
            row *= _SYMBOLS
            row -= 1
            np.add(row, upto, out=model.seen[t - made, :alive])
            place = flat_of + upto
            lower = starts.take(place)
            size = following.take(place)
            size -= lower
            size &= _TOTAL_MASK
            co -= lower * r
            r *= size
            r >>= _WIDTH_UPTO.take(upto)
            # a guess has no plain bits: what is left is below r then
            extra = co // r
            co -= r * extra
            extra += _FIRST_UPTO.take(upto)
            x = ids[t + 2, :alive]
            x[...] = extra
            np.copyto(x, guesses[0], where=upto == 1)
            np.copyto(x, guesses[1], where=upto == 2)
            small = r < _LEAST_SPAN
            shift = small * _UNIT
            co <<= shift
            co |= units.take(at, mode="clip") * small
            at += small * n
            np.left_shift(r, shift, out=sp)
            found <<= _ID_BITS
            found |= x
            model.guesses[slots] = found
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    by_block = np.ascontiguousarray(ids[2:].T).astype("<u4", copy=False)
    for k, i in enumerate(order):
        found = by_block[k, : lengths[k]].copy()
        if zlib.crc32(found.tobytes()) != heads[i][2]:
            raise ValueError("a block of token ids is damaged")
        result[i] = found
    return result


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, highest power in the lowest bit."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return product


@cache
def _behind(k: int) -> list[list[int]]:
    """What 2^k zero bytes behind make of a checksum, by each of its bytes, lowest first."""
    power = 1 << 23  # x^8
    for _ in range(k):
        power = _times(power, power)
    return [[_times(byte << 8 * at, power) for byte in range(256)] for at in range(4)]


def join_crc32(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings one behind the other, from theirs."""
    for k in range(second_bytes.bit_length()):
        if second_bytes >> k & 1:
            a, b, c, d = _behind(k)
            first = a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24]
    return first ^ second
