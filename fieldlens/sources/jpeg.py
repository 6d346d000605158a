"""JPEG images as arrays: baseline and progressive Huffman coding, any subsampling, grey, YCbCr, RGB or CMYK.

Bits are read symbol by symbol; all that works on samples (dequantisation, inverse transform, upsampling,
colour) is numpy over whole planes.
"""

from __future__ import annotations

import re
import struct

import numpy as np


def _zigzag() -> list[int]:
    """Place of each coefficient in its 8 x 8 block, by the order of the file: diagonals that turn at the border."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return [r * 8 + c for r, c in cells]


PLACE = _zigzag()
#: Columns are the cosine waves of the inverse transform.
WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


class _Plane:
    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table
        self.wide = self.high = 0  # blocks, padded to whole units
        self.coefficients: list[int] = []
        self.before = 0


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next, length << 8 | symbol of the code that they begin with; 0 where none does."""
    out: list[int] = []
    k = 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out += [size << 8 | symbols[k]] * (1 << (16 - size))
            k += 1
    return (out + [0] * (65536 - len(out)))[:65536]


class _Bits:
    """Reads the entropy-coded bytes between two restarts."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.int64)
        self.windows = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tolist()
        self.at, self.end = 0, len(raw) * 8 - 40  # a damaged end reads as zeros for a while

    def next16(self) -> int:
        if self.at > self.end:
            raise ValueError("the picture's data end too early")
        return self.windows[self.at >> 3] >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[int]) -> int:
        code = table[self.next16()]
        if not code:
            raise ValueError("no such code")
        self.at += code >> 8
        return code & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.next16() >> (16 - n)
        self.at += n
        return out

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Scan:
    """How the blocks of one scan are read; eob counts blocks that have no more coefficients in it."""

    def __init__(self, bits: _Bits, dc: list[int] | None, ac: list[int] | None, first: int, last: int, high: int, low: int) -> None:
        self.bits, self.dc, self.ac, self.first, self.last, self.high, self.low, self.eob = bits, dc, ac, first, last, high, low, 0

    def whole(self, p: _Plane, at: int) -> None:
        c, bits, ac = p.coefficients, self.bits, self.ac
        p.before += bits.signed(bits.symbol(self.dc))
        c[at] = p.before
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            if s & 15:
                k += s >> 4
                if k > 63:
                    raise ValueError("too many coefficients")
                c[at + PLACE[k]] = bits.signed(s & 15)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                return

    def dc_first(self, p: _Plane, at: int) -> None:
        p.before += self.bits.signed(self.bits.symbol(self.dc))
        p.coefficients[at] = p.before << self.low

    def dc_again(self, p: _Plane, at: int) -> None:
        p.coefficients[at] |= self.bits.take(1) << self.low

    def ac_first(self, p: _Plane, at: int) -> None:
        if self.eob:
            self.eob -= 1
            return
        k, bits = self.first, self.bits
        while k <= self.last:
            s = bits.symbol(self.ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise ValueError("too many coefficients")
                p.coefficients[at + PLACE[k]] = bits.signed(size) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.eob = (1 << run) - 1 + bits.take(run)
                return

    def ac_again(self, p: _Plane, at: int) -> None:
        c, bits, one = p.coefficients, self.bits, 1 << self.low

        def refine(place: int) -> None:
            if bits.take(1) and not abs(c[place]) & one:
                c[place] += one if c[place] > 0 else -one

        k = self.first
        if not self.eob:
            while k <= self.last:
                s = bits.symbol(self.ac)
                run, value = s >> 4, 0
                if s & 15:
                    value = one if bits.take(1) else -one
                elif run < 15:
                    self.eob = (1 << run) + bits.take(run)
                    break
                while k <= self.last:
                    place = at + PLACE[k]
                    if c[place]:
                        refine(place)
                    elif run:
                        run -= 1
                    else:
                        if value:
                            c[place] = value
                        k += 1
                        break
                    k += 1
        if self.eob:
            while k <= self.last:
                if c[at + PLACE[k]]:
                    refine(at + PLACE[k])
                k += 1
            self.eob -= 1


def _doubled(a: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis, each three parts its own and one part its neighbour's; in quarters."""
    a = np.moveaxis(a, axis, 0)
    before, after = np.concatenate([a[:1], a[:-1]]), np.concatenate([a[1:], a[-1:]])
    out = np.empty((2 * len(a), *a.shape[1:]), a.dtype)
    out[::2], out[1::2] = 3 * a + before, 3 * a + after
    return np.moveaxis(out, 0, axis)


def _sized(plane: np.ndarray, up: int, across: int, height: int, width: int) -> np.ndarray:
    a = plane.astype(np.float64)
    for axis, times in ((0, up), (1, across)):
        a = _doubled(a, axis) / 4 if times == 2 else np.repeat(a, times, axis)
    return a[:height, :width]


def _samples(p: _Plane, quantum: np.ndarray) -> np.ndarray:
    blocks = np.array(p.coefficients, np.float64).reshape(-1, 8, 8) * quantum
    pixels = np.matmul(np.matmul(WAVES, blocks), WAVES.T) + 128
    whole = pixels.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.high * 8, p.wide * 8)
    return np.clip(np.rint(whole), 0, 255)


def decode_jpeg(content: bytes) -> np.ndarray:
    """Height x width x 3; ValueError where the file is broken or of another kind."""
    if content[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quanta: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], list[int]] = {}
    planes: dict[int, _Plane] = {}
    width = height = restart = 0
    progressive, transform = False, None
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        kind = content[at + 1]
        if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                values = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8)
                table = np.zeros(64)
                table[PLACE] = values
                quanta[name] = table.reshape(8, 8)
                k += 1 + n
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                tables[body[k] >> 4, body[k] & 15] = _codes(counts, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not height or not width:
                raise ValueError("only 8 bits a sample, and a size that is stated")
            planes = {body[6 + 3 * k]: _Plane(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            h, v = max(p.h for p in planes.values()), max(p.v for p in planes.values())
            units = -(-width // (8 * h)), -(-height // (8 * v))
            for p in planes.values():
                p.wide, p.high = units[0] * p.h, units[1] * p.v
                p.coefficients = [0] * (p.wide * p.high * 64)
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline and progressive coding")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif kind == 0xDA:
            n = body[0]
            some = [(planes[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
            first, last, steps = body[1 + 2 * n : 4 + 2 * n]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(content, at)
            end = stop.start() if stop else len(content)
            _read(some, tables, (first, last, steps >> 4, steps & 15) if progressive else None, re.split(rb"\xff+[\xd0-\xd7]", content[at:end]), restart, (width, height), (h, v))
            at = end
    if not planes:
        raise ValueError("no picture")
    full = [_sized(_samples(p, quanta[p.table])[: -(-height * p.v // v), : -(-width * p.h // h)], v // p.v, h // p.h, height, width) for p in planes.values()]
    return _coloured(full, transform)


def _read(some: list[tuple[_Plane, int]], tables: dict[tuple[int, int], list[int]], part: tuple[int, int, int, int] | None, pieces: list[bytes], restart: int, size: tuple[int, int], most: tuple[int, int]) -> None:
    """One scan: units of all its planes' blocks, or the blocks of its one plane row by row."""
    if len(some) == 1:
        p = some[0][0]
        across, down = -(-size[0] * p.h // (8 * most[0])), -(-size[1] * p.v // (8 * most[1]))
        units = [[(p, some[0][1], (y * p.wide + x) * 64)] for y in range(down) for x in range(across)]
    else:
        across, down = some[0][0].wide // some[0][0].h, some[0][0].high // some[0][0].v
        units = [[(p, t, ((y * p.v + j) * p.wide + x * p.h + i) * 64) for p, t in some for j in range(p.v) for i in range(p.h)] for y in range(down) for x in range(across)]
    step = restart or len(units)
    for k, piece in zip(range(0, len(units), step), pieces, strict=False):
        bits = _Bits(piece)
        scans: dict[int, _Scan] = {}
        for p, t in some:
            p.before = 0
            scans[id(p)] = _Scan(bits, tables.get((0, t >> 4)), tables.get((1, t & 15)), *(part or (0, 63, 0, 0)))
        for unit in units[k : k + step]:
            for p, _, at in unit:
                s = scans[id(p)]
                if part is None:
                    s.whole(p, at)
                elif part[0] == 0:
                    (s.dc_again if part[2] else s.dc_first)(p, at)
                else:
                    (s.ac_again if part[2] else s.ac_first)(p, at)


def _coloured(planes: list[np.ndarray], transform: int | None) -> np.ndarray:
    if len(planes) == 1:
        planes = planes * 3
    elif len(planes) in (3, 4) and (transform if transform is not None else len(planes) == 3):
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    if len(planes) == 4:  # inks are stored inverted
        planes = [np.clip(p, 0, 255) * planes[3] / 255 for p in planes[:3]]
    return np.clip(np.rint(np.stack(planes[:3], axis=2)), 0, 255).astype(np.uint8)
