"""Media columns: payloads kept in progressive JPEG, read back as coefficients and as full-resolution RGB tensors.

A payload's bytes are the format's own lossless unit, quantised coefficients (byte - SHIFT, quantiser 1), 64 to a block,
six blocks (four of luma, two of chroma at half resolution) to a unit of 16 x 16 pixels. The file has a DC scan and band scans
(spectral selection), of which DC and the low band come in two steps (successive approximation). Restart markers cut each
scan into short intervals.

Decoding accumulates the scans into coefficient arrays. Intervals of all files of a batch are decoded side by side, one symbol of
each at a time, in numpy. The inverse transform is a product of whole numbers in double precision, hence exact and the same
in any batch; chroma is upsampled by repetition.

Nulls count as empty texts; an empty text is 64 zero bytes; texts of any length are stored whole (a file holds 65,535 pixels a side,
over 6 GB of payload); equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, pieces

SHIFT = 96
INTERVAL = 16  # blocks, or units of an interleaved scan, between restart markers
ROW = 64  # units in a row of the picture
CHUNK = 3 << 20
LOW = 5  # the low band is coefficients 1 to LOW

#: (components, first, last, high, low) of each scan; interleaved where there is more than one component.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), 1, LOW, 0, 1) for c in range(3)], *[((c,), LOW + 1, 63, 0, 0) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, LOW, 1, 0) for c in range(3)]]


def huffman(lengths: list[tuple[int, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """From (symbol, bits) in order of bits: the table segment's body, code and bits by symbol, and (bits << 8 | symbol) by the next 16 bits."""
    code, at, codes, bits, look = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    for symbol, n in lengths:
        code <<= n - at
        at = n
        codes[symbol], bits[symbol] = code, n
        look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        code += 1
    return bytes(sum(n == k for _, n in lengths) for k in range(1, 17)) + bytes(s for s, _ in lengths), codes, bits, look


def table_of(body: bytes) -> np.ndarray:
    """The lookup of a table segment's body."""
    counts, symbols, k, lengths = body[:16], body[16:], 0, []
    for n, c in enumerate(counts, 1):
        lengths += [(s, n) for s in symbols[k : k + c]]
        k += c
    return huffman(lengths)[3]


#: Sizes have four bits each; so have the end of a block and each size without a run. Runs have ten.
DC = huffman([(s, 4) for s in range(12)])
AC = huffman([(s, 4) for s in range(11)] + [(r << 4 | s, 10) for r in range(1, 16) for s in range(11)])


@dataclass
class Shape:
    """How a payload lies in a picture."""

    blocks: int

    @property
    def units(self) -> int:
        return -(-self.blocks // 6)

    @property
    def wide(self) -> int:
        return max(1, min(self.units, ROW if self.units <= ROW * 4095 else 4095))

    @property
    def high(self) -> int:
        return max(1, -(-self.units // self.wide))


# --- bits ------------------------------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> list[bytes]:
    """Values of up to 32 bits, in order of lanes, as bytes of each lane, the last one filled with ones."""
    per = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = (per + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    before = np.concatenate([[0], np.cumsum(per)])
    ends = np.cumsum(bits)
    start = first[lane] * 8 + (ends - bits) - before[lane]
    words = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
    if len(values):
        word = start >> 5
        v = values.astype(np.uint64) << (64 - (start & 31) - bits).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        at = word[new]
        words[at] += np.add.reduceat(v >> np.uint64(32), new)
        words[at + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), new)
    raw = words.astype(">u4").view(np.uint8)
    fill = (-per) % 8
    some = fill > 0
    raw[first[1:][some] - 1] |= ((1 << fill[some]) - 1).astype(np.uint8)
    body = raw.tobytes()
    return [body[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


class Bits:
    """Readers side by side, one for each lane."""

    def __init__(self, lanes: list[bytes]):
        size = np.array([len(x) for x in lanes], np.int64)
        raw = np.frombuffer(b"".join(lanes) + b"\0" * 16, np.uint8).astype(np.uint64)
        self.window = np.zeros(len(raw) - 8, np.uint64)
        for k in range(8):
            self.window |= raw[k : len(raw) - 8 + k] << np.uint64(56 - 8 * k)
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]]) * 8 if len(lanes) else np.zeros(0, np.int64)

    def peek(self, lane: np.ndarray) -> np.ndarray:
        at = self.at[lane]
        return self.window[at >> 3] << (at & 7).astype(np.uint64)


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of a size category's bits."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def top(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits of each window after skip bits."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


# --- encoding --------------------------------------------------------------------------------------------------------------


def size_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def tail_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def in_order(parts: list[tuple], lane_of: np.ndarray, lanes: int) -> list[bytes]:
    """Items (block, place, value, bits) of several kinds, put in order and packed."""
    block, place, value, bits = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(block * 66 + place, kind="stable")
    return pack_bits(value[order], bits[order], lane_of[block[order]], lanes)


def encode_band(c: np.ndarray, lane_of: np.ndarray, lanes: int) -> list[bytes]:
    """First scan of a band. c: blocks x coefficients, already shifted."""
    _, codes, bits, _ = AC
    block, k = np.nonzero(c)
    v = c[block, k].astype(np.int64)
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.concatenate([[0], k[:-1]]))
    run = k - before - 1
    long = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
    size = size_of(v)
    symbol = (run & 15) << 4 | size
    last = np.full(len(c), -1)
    last[block] = k
    short = np.flatnonzero(last < c.shape[1] - 1)
    one = lambda n, x: np.full(n, x)
    return in_order([(block[long], k[long], one(len(long), codes[0xF0]), one(len(long), bits[0xF0])), (block, k, codes[symbol] << size.astype(np.uint64) | tail_bits(v, size), bits[symbol] + size), (short, one(len(short), 64), one(len(short), codes[0]), one(len(short), bits[0]))], lane_of, lanes)


def encode_refinement(c: np.ndarray, lane_of: np.ndarray, lanes: int) -> list[bytes]:
    """Second scan of a narrow band (no run of 16): the lowest bit. c: blocks x coefficients."""
    _, codes, bits, _ = AC
    n, width = c.shape
    a = np.abs(c).astype(np.int64)
    run, held, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    parts = []
    for k in range(width):
        old, new = a[:, k] > 1, a[:, k] == 1
        at = np.flatnonzero(new)
        symbol = run[at] << 4 | 1
        value = (codes[symbol].astype(np.int64) << 1 | (c[at, k] > 0)) << count[at] | held[at]
        parts.append((at, np.full(len(at), k), value.astype(np.uint64), bits[symbol] + 1 + count[at]))
        held = np.where(new, 0, np.where(old, held << 1 | (a[:, k] & 1), held))
        count = np.where(new, 0, count + old)
        run = np.where(new, 0, run + (a[:, k] == 0))
    at = np.flatnonzero(a[:, -1] != 1)
    parts.append((at, np.full(len(at), 64), (codes[0].astype(np.int64) << count[at] | held[at]).astype(np.uint64), bits[0] + count[at]))
    return in_order(parts, lane_of, lanes)


def encode_dc(units: np.ndarray, first: np.ndarray, lane_of: np.ndarray, lanes: int) -> list[bytes]:
    """First DC scan. units: units x 6 of shifted values; first: whether a unit begins an interval."""
    y = units[:, :4].reshape(-1).astype(np.int64)
    d = np.empty_like(units, dtype=np.int64)
    start = np.repeat(first, 4)
    start[np.arange(len(start)) % 4 > 0] = False
    d[:, :4] = np.where(start, y, y - np.concatenate([[0], y[:-1]])).reshape(-1, 4)
    for c in (4, 5):
        v = units[:, c].astype(np.int64)
        d[:, c] = np.where(first, v, v - np.concatenate([[0], v[:-1]]))
    d = d.reshape(-1)
    size = size_of(d)
    return pack_bits(DC[1][size] << size.astype(np.uint64) | tail_bits(d, size), DC[2][size] + size, np.repeat(lane_of, 6), lanes)


class Layout:
    """Where the blocks of a batch of pictures lie: files one after another, each as luma, then both chroma planes, in raster order."""

    def __init__(self, shapes: list[Shape]):
        self.shapes = shapes
        units = np.array([s.wide * s.high for s in shapes], np.int64)
        self.first_unit = np.concatenate([[0], np.cumsum(units)])
        self.n_units = int(self.first_unit[-1])
        rows, first = [], self.first_unit.tolist()
        for s, u in zip(shapes, first):
            n = s.wide * s.high
            luma = u * 6 + np.arange(4 * n).reshape(s.high, 2, s.wide, 2).transpose(0, 2, 1, 3).reshape(n, 4)
            rows.append(np.hstack([luma, (u * 6 + 4 * n + np.arange(n))[:, None], (u * 6 + 5 * n + np.arange(n))[:, None]]))
        #: unit x 6 -> block
        self.block = np.concatenate(rows) if rows else np.zeros((0, 6), np.int64)

    def planes(self, c: int) -> list[tuple[int, int]]:
        """(first block, blocks) of component c in each file."""
        out = []
        for s, u in zip(self.shapes, self.first_unit.tolist()):
            n = s.wide * s.high
            out.append((u * 6, 4 * n) if c == 0 else (u * 6 + (3 + c) * n, n))
        return out

    def lanes(self, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of ranges: first, number, and range of each."""
        a, n = (np.array(x, np.int64) for x in zip(*ranges)) if ranges else (np.zeros(0, np.int64),) * 2
        per = -(-n // INTERVAL)
        of = np.repeat(np.arange(len(n)), per)
        step = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * INTERVAL
        return a[of] + step, np.minimum(INTERVAL, n[of] - step), of


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_files(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files of payloads, each of a positive multiple of 64 bytes."""
    shapes = [Shape(len(p) // 64) for p in payloads]
    lay = Layout(shapes)
    grid = np.zeros((lay.n_units * 6, 64), np.int16)
    order = lay.block.reshape(-1)
    for p, s, u in zip(payloads, shapes, lay.first_unit.tolist()):
        grid[order[u * 6 : u * 6 + s.blocks]] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - SHIFT
    units = [(u, s.wide * s.high) for u, s in zip(lay.first_unit.tolist(), shapes)]
    bodies = []
    for comps, lo, hi, high, low in SCANS:
        ranges = units if len(comps) > 1 else lay.planes(comps[0])
        first, n, of = lay.lanes(ranges)
        if len(comps) > 1:
            lane_of = np.repeat(np.arange(len(n)), n)
            dc = grid[lay.block, 0]
            if high:
                made = pack_bits((dc & 1).reshape(-1).astype(np.uint64), np.ones(dc.size, np.int64), np.repeat(lane_of, 6), len(n))
            else:
                begins = np.zeros(lay.n_units, bool)
                begins[first] = True
                made = encode_dc(dc >> low, begins, lane_of, len(n))
        else:
            blocks = np.concatenate([np.arange(a, a + m) for a, m in ranges])
            lane_of = np.repeat(np.arange(len(n)), n)
            c = grid[blocks, lo : hi + 1]
            if high:
                made = encode_refinement(c, lane_of, len(n))
            else:
                made = encode_band(np.sign(c) * (np.abs(c) >> low), lane_of, len(n))
        per: list[list[bytes]] = [[] for _ in payloads]
        for f, x in zip(of.tolist(), made):
            per[f].append(x.replace(b"\xff", b"\xff\0"))
        bodies.append(per)
    tables = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\0" + DC[0] + b"\x10" + AC[0])
    marks = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    out = []
    for f, (p, s) in enumerate(zip(payloads, shapes)):
        frame = struct.pack(">BHHB", 8, 16 * s.high, 16 * s.wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(p))), tables, segment(0xC2, frame), segment(0xDD, struct.pack(">H", INTERVAL))]
        for (comps, lo, hi, high, low), per in zip(SCANS, bodies):
            parts.append(segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([lo, hi, high << 4 | low])))
            for k, x in enumerate(per[f]):
                parts += [x] if k == 0 else [marks[(k - 1) % 8], x]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- decoding --------------------------------------------------------------------------------------------------------------

_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> dict:
    """Segments of a file: size of the payload, picture, tables, and scans with the intervals' bytes."""
    found: dict = {"scans": [], "tables": {}}
    k = 2
    while k < len(data) - 2:
        marker, n = data[k + 1], struct.unpack(">H", data[k + 2 : k + 4])[0]
        body = data[k + 4 : k + 2 + n]
        k += 2 + n
        if marker == 0xFE:
            found["bytes"] = struct.unpack(">Q", body)[0]
        elif marker == 0xC2:
            found["high"], found["wide"] = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                found["tables"][body[0]] = body[1:m]
                body = body[m:]
        elif marker == 0xDA:
            m = body[0]
            end = _END.search(data, k).start()
            scan = tuple(body[1 + 2 * c] - 1 for c in range(m)), body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            found["scans"].append((scan, [x.replace(b"\xff\0", b"\xff") for x in _RESTART.split(data[k:end])]))
            k = end
    return found


def decode_band(read: Bits, look: np.ndarray, grid: np.ndarray, first: np.ndarray, n: np.ndarray, lo: int, hi: int, low: int) -> None:
    """First scan of a band: a symbol of every interval at a time."""
    block, k, ends = first.copy(), np.full(len(n), lo), first + n
    live = np.arange(len(n))
    while len(live):
        w = read.peek(live)
        x = look[w >> np.uint64(48)].astype(np.int64)
        length, run, size = x >> 8, x >> 4 & 15, x & 15
        b, place = block[live], k[live]
        value = size > 0
        extra = np.where(value, size, np.where(run < 15, run, 0))
        bits = top(w, length, extra)
        read.at[live] += length + extra
        place = place + np.where(value | (run == 15), run, 0)
        at = np.flatnonzero(value)
        grid[b[at], place[at]] = extend(bits[at], size[at]) << low
        place += 1
        ended = ~value & (run < 15)
        over = ended | (place > hi)
        block[live] = b + np.where(ended, (1 << run) + bits, over)
        k[live] = np.where(over, lo, place)
        if over.any():
            live = live[block[live] < ends[live]]


def decode_refinement(read: Bits, look: np.ndarray, grid: np.ndarray, first: np.ndarray, n: np.ndarray, lo: int, hi: int, low: int) -> None:
    """Later scan of a band: a coefficient of every interval at a time."""
    step = 1 << low
    block, k, ends = first.copy(), np.full(len(n), lo), first + n
    run, value = np.full(len(n), -1), np.zeros(len(n), np.int64)  # run -1: a symbol is due
    rest = np.zeros(len(n), np.int64)  # blocks, this one included, that hold corrections only
    live = np.arange(len(n))
    while len(live):
        due = live[(run[live] < 0) & (rest[live] == 0)]
        if len(due):
            w = read.peek(due)
            x = look[w >> np.uint64(48)].astype(np.int64)
            length, r, size = x >> 8, x >> 4 & 15, x & 15
            extra = np.where(size > 0, 1, np.where(r < 15, r, 0))
            bits = top(w, length, extra)
            read.at[due] += length + extra
            ended = (size == 0) & (r < 15)
            rest[due] = np.where(ended, (1 << r) + bits, 0)
            run[due] = np.where(ended, -1, r)
            value[due] = np.where(size > 0, np.where(bits == 1, step, -step), 0)
        b, place = block[live], k[live]
        now = grid[b, place].astype(np.int64)
        old = now != 0
        w = read.peek(live)
        bit = (w >> np.uint64(63)).astype(np.int64) * old
        read.at[live] += old
        r = run[live]
        put = ~old & (r == 0)
        grid[b, place] = np.where(put, value[live], now + np.sign(now) * bit * step)
        run[live] = np.where(~old & (r >= 0), r - 1, r)
        over = place == hi
        k[live] = np.where(over, lo, place + 1)
        block[live] = b + over
        rest[live] -= over & (rest[live] > 0)
        if over.any():
            live = live[block[live] < ends[live]]


def decode_dc(read: Bits, look: np.ndarray, grid: np.ndarray, blocks: np.ndarray, first: np.ndarray, n: np.ndarray, low: int) -> None:
    """First DC scan: a block of every interval at a time."""
    last = np.zeros((len(n), 3), np.int64)
    for unit in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > unit)
        for j, c in enumerate((0, 0, 0, 0, 1, 2)):
            w = read.peek(live)
            x = look[w >> np.uint64(48)].astype(np.int64)
            length, size = x >> 8, x & 15
            last[live, c] += extend(top(w, length, size), size)
            read.at[live] += length + size
            grid[blocks[first[live] + unit, j], 0] = last[live, c] << low


def decode_grids(files: list[bytes]) -> tuple[np.ndarray, Layout, list[int]]:
    """Coefficients of all blocks of a batch of files, their layout, and the payloads' sizes."""
    parsed = [parse(f) for f in files]
    lay = Layout([Shape(p["bytes"] // 64) for p in parsed])
    grid = np.zeros((lay.n_units * 6, 64), np.int16)
    units = [(u, s.wide * s.high) for u, s in zip(lay.first_unit.tolist(), lay.shapes)]
    if any((p["wide"], p["high"]) != (16 * s.wide, 16 * s.high) or [s for s, _ in p["scans"]] != [s for s, _ in parsed[0]["scans"]] or p["tables"] != parsed[0]["tables"] for p, s in zip(parsed, lay.shapes)):
        raise ValueError("files of one batch must have the same scans and tables")
    tables = {k: table_of(v) for k, v in parsed[0]["tables"].items()} if parsed else {}
    k = 0
    scans = [s for s, _ in parsed[0]["scans"]] if parsed else []
    while k < len(scans):
        comps, lo, hi, high, low = scans[k]
        together = [k]  # the same band of other components has no bearing on this one, so they go together
        while len(comps) == 1 and together[-1] + 1 < len(scans) and len(scans[together[-1] + 1][0]) == 1 and scans[together[-1] + 1][1:] == (lo, hi, high, low):
            together.append(together[-1] + 1)
        lanes: list[bytes] = []
        ranges: list[tuple[int, int]] = []
        for i in together:
            ranges += units if len(scans[i][0]) > 1 else lay.planes(scans[i][0][0])
            for p in parsed:
                lanes += p["scans"][i][1]
        first, n, _ = lay.lanes(ranges)
        read = Bits(lanes)
        if len(comps) > 1 and high:
            for j in range(INTERVAL * 6):
                live = np.flatnonzero(n * 6 > j)
                if not len(live):
                    break
                grid[lay.block[first[live] + j // 6, j % 6], 0] |= ((read.peek(live) >> np.uint64(63)).astype(np.int16) << low)
                read.at[live] += 1
        elif len(comps) > 1:
            decode_dc(read, tables[0], grid, lay.block, first, n, low)
        elif high:
            decode_refinement(read, tables[0x10], grid, first, n, lo, hi, low)
        else:
            decode_band(read, tables[0x10], grid, first, n, lo, hi, low)
        k = together[-1] + 1
    return grid, lay, [p["bytes"] for p in parsed]


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient, along the diagonals."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in cells])


def _basis() -> np.ndarray:
    """Coefficient (in file order) x pixel, times 2**20, whole numbers."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[_zigzag()] * (1 << 20))


BASIS = _basis()


def tiles(grid: np.ndarray, lay: Layout) -> np.ndarray:
    """units x 16 x 16 x 3, RGB."""
    out = np.empty((lay.n_units, 16, 16, 3), np.uint8)
    for at in range(0, lay.n_units, 2048):
        units = lay.block[at : at + 2048]
        n = len(units)
        pixels = np.clip(np.floor(grid[units.reshape(-1)].astype(np.float64) @ BASIS / (1 << 20) + 0.5) + 128, 0, 255).astype(np.int32).reshape(n, 6, 8, 8)
        y = pixels[:, :4].reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16)
        cb, cr = (pixels[:, c].repeat(2, axis=1).repeat(2, axis=2) - 128 for c in (4, 5))
        for c, v in enumerate((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))):
            out[at : at + n, :, :, c] = np.clip(v, 0, 255)
    return out


def payload_of(grid: np.ndarray, lay: Layout, f: int) -> bytes:
    u = int(lay.first_unit[f])
    blocks = lay.block[u : u + lay.shapes[f].units].reshape(-1)[: lay.shapes[f].blocks]
    return (grid[blocks] + SHIFT).astype(np.uint8).tobytes()


def tensor_of(rgb: np.ndarray, lay: Layout, f: int) -> np.ndarray:
    """height x width x 3 of one file."""
    s, u = lay.shapes[f], int(lay.first_unit[f])
    return rgb[u : u + s.wide * s.high].reshape(s.high, s.wide, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * s.high, 16 * s.wide, 3)


def features(rgb: np.ndarray, lay: Layout) -> list[str]:
    """Of each picture: its size, mean colour, mean square of green, and which of 64 runs of its units (all of them, as even as can be) are brighter than its mean."""
    sums = rgb.reshape(len(rgb), 256, 3).sum(axis=1, dtype=np.int64)
    square = np.einsum("np,np->n", *[rgb[..., 1].reshape(len(rgb), 256).astype(np.int64)] * 2)
    out = []
    for f, s in enumerate(lay.shapes):
        a, b = int(lay.first_unit[f]), int(lay.first_unit[f + 1])
        n = (b - a) * 256
        total = sums[a:b].sum(axis=0)
        runs = min(64, b - a)
        first = np.arange(runs + 1) * (b - a) // runs
        bright = np.add.reduceat(sums[a:b].sum(axis=1), first[:-1]) * (b - a) > total.sum() * np.diff(first)
        mark = np.packbits(np.pad(bright, (0, 64 - runs))).tobytes().hex()
        out.append(f"{16 * s.wide}x{16 * s.high};" + ",".join(f"{x / n:.4f}" for x in total.tolist()) + f";{int(square[a:b].sum()) / n:.4f};{mark}")
    return out


# --- columns ---------------------------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text + b"\0" * (64 if not text else -len(text) % 64)


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes (of the text) and media (a progressive JPEG file)."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    at = len(keep)

    def run(b: pa.RecordBatch) -> dict:
        raw = ["" if t is None else t for t in b.column(at).to_pylist()]
        raw = [t.encode("utf-8", "replace") for t in raw]
        media, k = [], 0
        while k < len(raw):
            j, size = k, 0
            while j < len(raw) and (j == k or size + len(raw[j]) <= CHUNK):
                size += len(raw[j])
                j += 1
            media += encode_files([padded(t) for t in raw[k:j]])
            k = j
        return {c: b.column(i) for i, c in enumerate(keep)} | {"n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(media, pa.binary())}

    return map_batches(df.select(*keep, text), run, ", ".join([*kept, "n_bytes long", "media binary"]))


def load(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), tensors: bool = True) -> DataFrame:
    """keep columns and what the media hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the tensor: height, width and rgb (its bytes, height x width x 3). tensors: whether the last three are wanted."""
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    more = ["height int", "width int", "rgb binary"] if tensors else []
    names = ["payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", *more]

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n.split()[0]: [] for n in names}
        for part in pieces(b, CHUNK):
            files = part.column(len(keep)).to_pylist()
            grid, lay, sizes = decode_grids(files)
            rgb = tiles(grid, lay)
            for f, (data, size) in enumerate(zip(files, sizes)):
                p = payload_of(grid, lay, f)
                out["payload_bytes"].append(size)
                out["payload_sha256"].append(hashlib.sha256(p).hexdigest())
                out["tail_crc32"].append(zlib.crc32(p[-64:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                if tensors:
                    t = tensor_of(rgb, lay, f)
                    out["height"].append(t.shape[0])
                    out["width"].append(t.shape[1])
                    out["rgb"].append(t.tobytes())
            out["feature"] += features(rgb, lay)
        return {c: b.column(i) for i, c in enumerate(keep)} | out

    return map_batches(df.select(*keep, "media"), run, ", ".join([*kept, *names]))
