"""Progressive JPEG media columns.

A payload is kept in the quantised coefficients of a progressive JPEG with three
components and halved chroma: byte k of each 64 bytes is coefficient k, in zigzag order
and as a signed number, of one block; blocks fill Y, then Cb, then Cr. Coefficients go
through the file untouched, so the payload comes back exactly, while pixels are what a
viewer would show. Files hold these scans for each component: DC without its last bit, coefficients 1
to 5 without their last bit, 6 to 63, then the last bits of 1 to 5 and of the DC.

The reader takes the scans as the file describes them (spectral selection, successive
approximation, end-of-band runs, restart intervals, its own Huffman tables) and adds them up in
coefficient arrays. All restart segments of all files of a batch are decoded side by side, a
symbol of each at a time, with numpy. Then blocks are transformed, chroma is
repeated to full resolution and pixels become RGB. Quantisation tables scale the coefficients for pixels, not the payload.

Defined cases: a null or empty payload is 64 zero bytes; repeated rows give repeated
rows; a null id stays null; a null media value gives null results; files that are not of
this kind raise an error; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

#: Blocks between restart markers.
RESTART = 8
#: (first coefficient, last, bit position before, bit position after) of the scans.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (1, 5, 1, 0), (0, 0, 1, 0))
#: Minimum coded units that are turned into pixels together.
UNITS = 1024
#: Payload bytes that are encoded together, and file bytes that are decoded together.
ENCODED, DECODED = 1 << 18, 1 << 22

_BITS = np.array([i.bit_length() for i in range(1024)])


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Position in a block, row by row, of each coefficient in the order of the file."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(1)
def transform() -> np.ndarray:
    """Inverse cosine transform of a block as a matrix from coefficients in file order to pixels."""
    x = np.arange(8)
    base = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[:, None] / 2
    return np.einsum("ux,vy->uvxy", base, base).reshape(64, 64)[zigzag()]


def _lengths_ac() -> dict[int, int]:
    """Code lengths for (zeros before, size) symbols: short for runs of full coefficients, as text has them."""
    short = {0x07: 2, 0x06: 2, 0x05: 3, 0x08: 4, 0x04: 5, 0x00: 5, 0x01: 6, 0x02: 6, 0x03: 6}
    return short | {16 * run + size: 10 for run in range(1, 16) for size in range(1, 9)} | {0xF0: 10}


@lru_cache(2)
def tables() -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """DHT bodies (counts and symbols) for DC and AC, and code and length by symbol of each."""
    out = []
    for lengths in ({s: 4 for s in range(12)}, _lengths_ac()):
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        body = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)) + bytes(order)
        code, size = canonical(body)
        out.append((body, code, size))
    return out[0][0], out[1][0], out[0][1], out[0][2], out[1][1], out[1][2]


def canonical(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol of a DHT body."""
    code, size, at, now = np.zeros(256, np.int64), np.zeros(256, np.int64), 16, 0
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            code[body[at]], size[body[at]] = now, n
            now, at = now + 1, at + 1
        now <<= 1
    return code, size


@lru_cache(64)
def lookup(body: bytes) -> np.ndarray:
    """symbol * 32 + code length for each run of 16 bits; 0 where no code begins so."""
    code, size = canonical(body)
    out = np.zeros(1 << 16, np.int64)
    for symbol in body[16:]:
        n = int(size[symbol])
        out[int(code[symbol]) << (16 - n) : (int(code[symbol]) + 1) << (16 - n)] = symbol * 32 + n
    return out


def shape(blocks: int) -> tuple[int, int]:
    """Columns and rows of the minimum coded units (six blocks each) that hold ``blocks``."""
    units = -(-blocks // 6)
    columns = max(1, int(units**0.5))
    return columns, -(-units // columns)


def _size(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes, which are below 1024."""
    return _BITS[np.abs(x)]


def _tokens(coef: np.ndarray, fresh: np.ndarray, scan: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, bits, number of bits) of a scan over blocks; ``fresh`` marks those that follow a restart."""
    first, last, before, after = scan
    _, _, dc_code, dc_size, ac_code, ac_size = tables()
    n = len(coef)
    at = np.arange(n)
    if first == 0:
        dc = coef[:, 0].astype(np.int64)
        if before:
            return at, (dc >> after) & 1, np.ones(n, np.int64)
        dc >>= after
        gap = dc - np.where(fresh, 0, np.concatenate(([0], dc[:-1])))
        size = _size(gap)
        extra = np.where(gap < 0, gap + (1 << size) - 1, gap)
        return at, (dc_code[size] << size) | extra, dc_size[size] + size
    band = coef[:, first : last + 1].astype(np.int64)
    if before:
        return _refining(band, after)
    value = np.sign(band) * (np.abs(band) >> after)
    row, col = np.nonzero(value)
    value = value[row, col]
    start = np.ones(len(row), bool)
    start[1:] = row[1:] != row[:-1]
    run = col - np.where(start, -1, np.concatenate(([-1], col[:-1]))) - 1
    size = _size(value)
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    symbol = (run & 15) * 16 + size
    blocks, bits, lengths = [row], [(ac_code[symbol] << size) | extra], [ac_size[symbol] + size]
    order = [row * 256 + col * 2 + 1]
    long = np.flatnonzero(run > 15)
    if len(long):
        times = run[long] >> 4
        own = np.repeat(long, times)
        blocks.append(row[own])
        bits.append(np.full(len(own), ac_code[0xF0]))
        lengths.append(np.full(len(own), ac_size[0xF0]))
        order.append(row[own] * 256 + col[own] * 2)
    final = np.full(n, -1)
    np.maximum.at(final, row, col)
    short = np.flatnonzero(final < last - first)
    blocks.append(short)
    bits.append(np.full(len(short), ac_code[0]))
    lengths.append(np.full(len(short), ac_size[0]))
    order.append(short * 256 + 255)
    sort = np.argsort(np.concatenate(order), kind="stable")
    return tuple(np.concatenate(x)[sort] for x in (blocks, bits, lengths))


def _refining(band: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a scan that adds a bit to a band of few coefficients."""
    _, _, _, _, ac_code, ac_size = tables()
    size = np.abs(band) >> after
    old = size > 1
    n, width = band.shape
    # without new coefficients: end of band, then a bit for each old one
    bits, count = np.full(n, ac_code[0]), np.full(n, ac_size[0])
    for k in range(width):
        bits = np.where(old[:, k], (bits << 1) | (size[:, k] & 1), bits)
        count += old[:, k]
    blocks = np.arange(n)
    odd = np.flatnonzero((size == 1).any(1))
    if not len(odd):
        return blocks, bits, count
    parts: list[tuple[int, int, int]] = []
    for b in odd.tolist():
        run, held = 0, []
        news = np.flatnonzero(size[b] == 1)
        for k in range(width):
            if old[b, k]:
                held.append(int(size[b, k] & 1))
            elif size[b, k] == 1:
                symbol = 16 * run + 1
                parts.append((b, (int(ac_code[symbol]) << 1) | int(band[b, k] > 0), int(ac_size[symbol]) + 1))
                parts += [(b, bit, 1) for bit in held]
                run, held = 0, []
            else:
                run += 1
        if news[-1] < width - 1:
            parts.append((b, int(ac_code[0]), int(ac_size[0])))
            parts += [(b, bit, 1) for bit in held]
    keep = np.ones(n, bool)
    keep[odd] = False
    extra = np.array(parts, np.int64).reshape(-1, 3)
    blocks, bits, count = (np.concatenate((x[keep], extra[:, i])) for i, x in enumerate((blocks, bits, count)))
    sort = np.argsort(blocks, kind="stable")
    return blocks[sort], bits[sort], count[sort]


def _coded(segment: np.ndarray, total: int, bits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with stuffing, byte offsets) of all segments, each filled up with ones."""
    size = np.bincount(segment, weights=count, minlength=total).astype(np.int64)
    start = np.concatenate(([0], np.cumsum((size + 7) // 8)))
    ends = np.cumsum(count)
    inside = ends - count - np.concatenate(([0], np.cumsum(size)))[segment]
    at = start[segment] * 8 + inside
    fill = np.flatnonzero(size % 8)
    pad = 8 - size[fill] % 8
    at, bits, count = np.concatenate((at, start[fill] * 8 + size[fill])), np.concatenate((bits, (1 << pad) - 1)), np.concatenate((count, pad))
    wide = bits << (32 - count - (at & 7))
    out = np.zeros(start[-1] + 4)
    for j in range(4):
        out += np.bincount((at >> 3) + j, weights=(wide >> (24 - 8 * j)) & 255, minlength=len(out))
    raw = out[: start[-1]].astype(np.uint8)
    full = raw == 255
    before = np.concatenate(([0], np.cumsum(full)))
    stuffed = np.zeros(len(raw) + before[-1], np.uint8)
    stuffed[np.arange(len(raw)) + before[:-1]] = raw
    return stuffed, start + before[start]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload; lengths are positive multiples of 64."""
    blocks = [len(p) // 64 for p in payloads]
    shapes = [shape(b) for b in blocks]
    count = np.array([6 * c * r for c, r in shapes])
    base = np.concatenate(([0], np.cumsum(count)))
    coef = np.zeros((base[-1], 64), np.int8)
    for p, b, n in zip(payloads, base[:-1], blocks, strict=True):
        coef[b : b + n] = np.frombuffer(p, np.int8).reshape(-1, 64)
    units = count // 6
    parts = np.stack((4 * units, units, units), 1).ravel()  # blocks of each component
    edge = np.concatenate(([0], np.cumsum(parts)))
    owner = np.repeat(np.arange(len(parts)), parts)
    inside = np.arange(base[-1]) - edge[owner]
    many = -(-parts // RESTART)
    first = np.concatenate(([0], np.cumsum(many)))
    segment = first[owner] + inside // RESTART
    fresh = inside % RESTART == 0
    number = np.arange(first[-1]) - np.repeat(first[:-1], many)  # of the segment in its component
    coded = []
    for scan in SCANS:
        block, bits, length = _tokens(coef, fresh, scan)
        data, offs = _coded(segment[block], first[-1], bits, length)
        marks = np.flatnonzero(number > 0)  # a restart marker before each segment but the first
        shift = np.zeros(first[-1] + 1, np.int64)
        shift[1:] = np.cumsum(number > 0)
        own = np.repeat(np.arange(first[-1]), np.diff(offs))
        out = np.empty(len(data) + 2 * len(marks), np.uint8)
        out[np.arange(len(data)) + 2 * shift[own + 1]] = data
        lead = offs[marks] + 2 * shift[marks]
        out[lead], out[lead + 1] = 255, 0xD0 + (number[marks] - 1) % 8
        coded.append((out.tobytes(), (offs + 2 * shift)[first].tolist()))
    dc, ac = tables()[:2]
    quant = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
    huff = b"".join(b"\xff\xc4" + (len(t) + 3).to_bytes(2, "big") + bytes([k]) + t for k, t in ((0, dc), (16, ac)))
    restart = b"\xff\xdd\x00\x04" + RESTART.to_bytes(2, "big")
    heads = [[b"\xff\xda\x00\x08\x01" + bytes([c + 1, 0, a, b, 16 * h + low]) for c in range(3)] for a, b, h, low in SCANS]
    files = []
    for i, ((c, r), p) in enumerate(zip(shapes, payloads, strict=True)):
        note = b"payload=%d" % len(p)
        frame = b"\xff\xc2\x00\x11\x08" + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        body = [b"\xff\xd8\xff\xfe", (len(note) + 2).to_bytes(2, "big"), note, quant, frame, huff, restart]
        for (data, offs), own in zip(coded, heads, strict=True):
            for k in range(3):
                body += (own[k], data[offs[3 * i + k] : offs[3 * i + k + 1]])
        files.append(b"".join([*body, b"\xff\xd9"]))
    return files


_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> dict:
    """Size, payload length, components and scans (parameters, tables, entropy-coded bytes) of a file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, huff, quant, restart, out = 2, {}, {}, 0, {"scans": [], "payload": None}
    while True:
        kind = data[at + 1]
        if kind == 0xD9:
            if [x[:2] for x in out["parts"].values()] != [(2, 2), (1, 1), (1, 1)] or out["width"] % 16 or out["height"] % 16:
                raise ValueError("not three components with halved chroma in whole units")
            out["quant"] = {part: quant.get(x[2], np.ones(64, np.int64)) for part, x in out["parts"].items()}
            return out
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE and body.startswith(b"payload="):
            out["payload"] = int(body[8:])
        elif kind == 0xC2:
            out["height"], out["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, f">u{wide}", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG file")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]], body = body[1:n], body[n:]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDA:
            if body[0] != 1:
                raise ValueError("a scan of several components")
            first, last, low = body[3:6]
            table = huff.get(body[2] >> 4 if first == 0 else 16 + (body[2] & 15), b"")
            found = _MARK.search(data, at)
            end = found.start()
            out["scans"].append((body[1], (first, last, low >> 4, low & 15), table, restart, data[at:end]))
            at = end


class Lanes:
    """Restart segments, decoded side by side. Bits are read from one array of unstuffed bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, first: np.ndarray, blocks: np.ndarray):
        wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
        self.words = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]).astype(np.int64)
        self.at, self.block, self.end = start * 8, first.copy(), first + blocks

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n bits, 24 at most."""
        return ((self.words[at >> 3] << (at & 7)) & 0xFFFFFFFF) >> (32 - n)

    def dc(self, coef: np.ndarray, table: np.ndarray, low: int) -> None:
        at, block, last = self.at, self.block, np.zeros(len(self.at), np.int64)
        while len(at):
            entry = table[self.peek(at, 16)]
            at = at + (entry & 31)
            size = entry >> 5
            bits = self.peek(at, size)
            at = at + size
            last = last + np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            coef[block, 0] = last << low
            block = block + 1
            go = block < self.end
            if not go.all():
                at, block, last, self.end = at[go], block[go], last[go], self.end[go]

    def dc_bit(self, coef: np.ndarray, low: int) -> None:
        count = self.end - self.block
        lane = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
        coef[self.block[lane] + nth, 0] |= (self.peek(self.at[lane] + nth, 1) << low).astype(coef.dtype)

    def ac(self, coef: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
        flat = coef.reshape(-1)
        at, place, end = self.at, self.block * 64 + first, self.end
        while len(at):
            entry = table[self.peek(at, 16)]
            at = at + (entry & 31)
            size, run = (entry >> 5) & 15, entry >> 9
            n = np.where((size == 0) & (run < 15), run, size)
            bits = self.peek(at, n)
            at = at + n
            full = size > 0
            value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits) << low
            if full.all():
                place = place + run
                flat[place] = value
                block = place >> 6
                over = (place & 63) >= last
                place = place + 1
            else:
                to = place + np.where(full, run, 0)
                flat[to[full]] = value[full]
                k = (place & 63) + np.where(full, run + 1, np.where(run == 15, 16, 0))
                ended = ~full & (run < 15)
                over = ended | (k > last)
                block = (place >> 6) + np.where(ended, (1 << run) + bits - 1, 0)
                place = block * 64 + k
            place = np.where(over, (block + 1) * 64 + first, place)
            go = (place >> 6) < end
            if not go.all():
                at, place, end = at[go], place[go], end[go]

    def ac_bit(self, coef: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
        flat, one = coef.reshape(-1), 1 << low
        at, block, end = self.at, self.block, self.end
        k = np.full(len(at), first)
        mode = np.zeros(len(at), np.int64)  # 0: a symbol comes, 1: zeros are skipped, 2: the band has ended
        run, fresh, bands = (np.zeros(len(at), np.int64) for _ in range(3))
        while len(at):
            new = np.flatnonzero(mode == 0)
            if len(new):
                p = at[new]
                entry = table[self.peek(p, 16)]
                p = p + (entry & 31)
                r, s = entry >> 9, (entry >> 5) & 15
                ended = (s == 0) & (r < 15)
                n = np.where(ended, r, s)
                bits = self.peek(p, n)
                at[new] = p + n
                run[new], fresh[new] = r, np.where(s > 0, np.where(bits > 0, one, -one), 0)
                bands[new] = np.where(ended, (1 << r) + bits, 0)
                mode[new] = np.where(ended, 2, 1)
            place = block * 64 + k
            now = flat[place].astype(np.int64)
            old = now != 0
            bit = np.where(old, self.peek(at, 1), 0)
            at = at + old
            fits = (np.abs(now) & one) == 0
            hit = ~old & (mode == 1) & (run == 0)
            flat[place] = np.where(old & (bit > 0) & fits, now + np.sign(now) * one, np.where(hit, fresh, now)).astype(flat.dtype)
            run = run - (~old & (mode == 1))
            mode = np.where(hit, 0, mode)
            k = k + 1
            over = k > last
            k = np.where(over, first, k)
            block = block + over
            bands = bands - (over & (mode == 2))
            mode = np.where(over & ((mode == 1) | (bands == 0)), 0, mode)
            go = block < end
            if not go.all():
                at, block, end, k, mode, run, fresh, bands = (x[go] for x in (at, block, end, k, mode, run, fresh, bands))


def coefficients(files: list[dict]) -> tuple[np.ndarray, np.ndarray, list[dict[int, int]]]:
    """(coefficients, first block of each file, first block by component) of parsed files."""
    where, total, starts = [], 0, []
    for f in files:
        starts.append(total)
        most = [max(p[i] for p in f["parts"].values()) for i in (0, 1)]
        own = {}
        for part, (h, v, _) in f["parts"].items():
            wide = -(-(-(-f["width"] * h // most[0])) // 8)
            high = -(-(-(-f["height"] * v // most[1])) // 8)
            own[part] = (total, wide * high)
            total += wide * high
        where.append(own)
    coef = np.zeros((total, 64), np.int16)
    queues = []  # components are independent; the scans of each stay in order
    for f, own in zip(files, where, strict=True):
        mine: dict[int, list] = {part: [] for part in own}
        for part, scan, table, restart, data in f["scans"]:
            mine[part].append(((scan, table, restart), (data, *own[part])))
        queues += mine.values()
    for turn in range(max(map(len, queues), default=0)):
        groups: dict[tuple, list] = {}
        for queue in queues:
            if turn < len(queue):
                groups.setdefault(queue[turn][0], []).append(queue[turn][1])
        for (scan, table, restart), members in groups.items():
            _scan(coef, scan, table, restart, members)
    return coef, np.array(starts), [{k: v[0] for k, v in own.items()} for own in where]


def _scan(coef: np.ndarray, scan: tuple[int, int, int, int], table: bytes, restart: int, members: list) -> None:
    raw = np.frombuffer(b"".join(m[0] for m in members), np.uint8)
    blocks = np.array([m[2] for m in members])
    size = np.array([len(m[0]) for m in members])
    follows = np.zeros(len(raw), bool)
    follows[1:] = raw[:-1] == 255
    marker = follows & (raw >= 0xD0) & (raw <= 0xD7)
    keep = ~(follows & (raw == 0)) & ~marker
    keep[:-1] &= ~marker[1:]
    before = np.concatenate(([0], np.cumsum(keep)))
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    start = np.sort(np.concatenate((before[begin], before[np.flatnonzero(marker)])))
    step = np.full(len(members), restart) if restart else blocks
    many = -(-blocks // step)
    if many.sum() != len(start):
        raise ValueError("restart markers are missing")
    owner = np.repeat(np.arange(len(members)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = np.array([m[1] for m in members])[owner] + nth * step[owner]
    count = np.minimum(step[owner], blocks[owner] - nth * step[owner])
    lanes = Lanes(raw[keep], start, first, count)
    low, high, old, now = scan
    if low == 0:
        lanes.dc_bit(coef, now) if old else lanes.dc(coef, lookup(table), now)
    elif old:
        lanes.ac_bit(coef, lookup(table), low, high, now)
    else:
        lanes.ac(coef, lookup(table), low, high, now)


def pixels(blocks: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of blocks of coefficients (n, 64), as (n, 8, 8)."""
    # the small shift keeps exact halves from depending on the order of summation
    return np.clip(np.floor(blocks.astype(np.float64) @ transform() + (128.5 + 1e-6)), 0, 255).astype(np.int32).reshape(-1, 8, 8)


def rgb_units(coef: np.ndarray, luma: np.ndarray, blue: np.ndarray, red: np.ndarray) -> np.ndarray:
    """RGB of units, (n, 16, 16, 3), from the numbers of their blocks; ``luma`` is (n, 4)."""
    y = pixels(coef[luma.ravel()]).reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (np.repeat(np.repeat(pixels(coef[x]) - 128, 2, 1), 2, 2) for x in (blue, red))
    out = np.stack((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)), -1)
    return np.clip(out, 0, 255).astype(np.uint8)


def decode(media: list[bytes], tensors: bool = False) -> list[dict]:
    """payload, feature, width, height and, if asked for, the RGB tensor (height, width, 3) of files."""
    files = [parse(m) for m in media]
    coef, _, where = coefficients(files)
    columns, rows = (np.array([f[k] // 16 for f in files]) for k in ("width", "height"))
    units = columns * rows
    owner = np.repeat(np.arange(len(files)), units)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    wide = columns[owner]
    y0, b0, r0 = (np.array([list(w.values())[i] for w in where])[owner] for i in range(3))
    corner = y0 + 4 * wide * (nth // wide) + 2 * (nth % wide)
    luma = np.stack((corner, corner + 1, corner + 2 * wide, corner + 2 * wide + 1), 1)
    shades = coef
    if any((q != 1).any() for f in files for q in f["quant"].values()):
        starts = np.append([b for w in where for b in w.values()], len(coef))
        steps = np.stack([q for f in files for q in f["quant"].values()])
        shades = coef * np.repeat(steps, np.diff(starts), 0)
    sums, squares = np.zeros((2, len(files), 3), np.int64)
    shown: list[np.ndarray] = []
    for i in range(0, len(owner), UNITS):
        mine = slice(i, i + UNITS)
        part = rgb_units(shades, luma[mine], (b0 + nth)[mine], (r0 + nth)[mine])
        flat = part.reshape(len(part), 256, 3).astype(np.int64)
        np.add.at(sums, owner[mine], flat.sum(1))
        np.add.at(squares, owner[mine], (flat * flat).sum(1))
        if tensors:
            shown.append(part)
    whole = np.concatenate(shown) if shown else None
    out, at = [], 0
    for i, f in enumerate(files):
        n = 256 * int(units[i])
        mean = sums[i] / n
        spread = np.sqrt(np.maximum(squares[i] / n - mean * mean, 0))
        first = min(where[i].values())
        used = f["payload"] if f["payload"] is not None else 6 * 64 * int(units[i])
        payload = coef[first : first + used // 64].astype(np.int8).tobytes()
        row = {"payload": payload, "width": f["width"], "height": f["height"], "feature": f"{f['width']}x{f['height']};" + ",".join(f"{x:.3f}" for x in (*mean, *spread))}
        if tensors:
            own = whole[at : at + int(units[i])].reshape(int(rows[i]), int(columns[i]), 16, 16, 3)
            row["rgb"] = own.transpose(0, 2, 1, 3, 4).reshape(16 * int(rows[i]), 16 * int(columns[i]), 3)
        out.append(row)
        at += int(units[i])
    return out


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("payload", pa.binary()), ("rgb", pa.binary())])
_READ_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, payload binary, rgb binary"


def _stored(batches):
    for batch in batches:
        for lo, hi, raw, offs in words.slices(batch.column(1), ENCODED):
            texts = [raw[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            media = encode([t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts])
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(media, pa.binary())], schema=_STORED)


def gathered(batches):
    """The columns of batches as lists, of about ``DECODED`` bytes together."""
    held, size = ([], [], []), 0
    for batch in batches:
        media = batch.column(2).to_pylist()
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), media, strict=True):
            for column, x in zip(held, row, strict=True):
                column.append(x)
            size += len(row[2] or b"")
            if size >= DECODED:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def _reading(payloads: bool, tensors: bool):
    def run(batches):
        for keys, sizes, media in gathered(batches):
            some = [i for i, m in enumerate(media) if m is not None]
            found = dict(zip(some, decode([media[i] for i in some], tensors), strict=True)) if some else {}
            rows = []
            for i, (key, size, data) in enumerate(zip(keys, sizes, media, strict=True)):
                if i not in found:
                    rows.append((key, size, *[None] * 10))
                    continue
                x = found[i]
                p = x["payload"]
                rows.append((key, size, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), x["feature"], x["width"], x["height"], p if payloads else None, x["rgb"].tobytes() if tensors else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    return run


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a progressive JPEG."""
    common.arrow_rows(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return base.mapInArrow(words.released(_stored), "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, payloads: bool = True, tensors: bool = False) -> DataFrame:
    """Digests, features, payloads and RGB tensors of (doc_id, n_bytes, media)."""
    common.arrow_rows(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(words.released(_reading(payloads, tensors)), _READ_DDL)


def stored_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`stored` as a table, :func:`read` from it with the RGB tensors; rows times columns times 3 bytes each."""
    media = common.table(stored(docs, id_col, text_col), "media")
    return read(media, payloads=False, tensors=True).drop("payload")
