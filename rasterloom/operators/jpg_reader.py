"""Pixels of JPG bytes on numpy: sequential and progressive Huffman files of 8 bits a sample.

Coefficients are collected over all scans first; dequantising, the inverse
transform, scaling up of subsampled planes and the colour transform then run on
whole planes at once.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Pixels of the largest image that is decoded; a header may claim any size.
MOST_PIXELS = 1 << 28
#: Up to so many samples of all planes are transformed at once; larger images take a plane at a time, for memory.
TOGETHER = 1 << 18


class JpgError(ValueError):
    """Bytes that are no whole JPG of these kinds."""


@dataclass
class _Plane:
    """One component: its sampling, tables and coefficients (64 for each block, in the order of the file)."""

    across: int
    down: int
    quantiser: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    values: array = field(default_factory=lambda: array("q"))


class _Bits:
    """Bits of the entropy-coded data between two markers."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def fill(self) -> None:
        """Hold 32 bits or more; zeros follow the end."""
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held & ((1 << self.count) - 1)) << 48 | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.count += 48

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.count < n:
            self.fill()
        self.count -= n
        return self.held >> self.count & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        """A value of n bits whose first bit says that it is positive."""
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: tuple[int, list[int]]) -> int:
        if self.count < 16:
            self.fill()
        wide, entries = table
        found = entries[self.held >> (self.count - wide) & ((1 << wide) - 1)]
        if not found:
            raise JpgError("bad code in JPG")
        self.count -= found >> 8
        return found & 0xFF

    def check_end(self) -> None:
        if 8 * self.at - self.count > 8 * len(self.data):
            raise JpgError("JPG ends within a scan")


@lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> tuple[int, list[int]]:
    """The length of the longest code and, for each so many bits that may come: length << 8 | symbol of the code they begin with, or 0.

    Many files share their codes, so the latest tables are kept; nothing changes them.
    """
    longest = max((size for size in range(1, 17) if counts[size - 1]), default=0)
    table, code, k = [], 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            if code >= 1 << size or k >= len(symbols):
                raise JpgError("bad code table in JPG")
            table += [size << 8 | symbols[k]] * (1 << (longest - size))  # codes follow one another without gaps
            code, k = code + 1, k + 1
        code <<= 1
    return longest, table + [0] * ((1 << longest) - len(table))


@lru_cache(maxsize=64)
def _quantiser(numbers: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(numbers, ">u2" if wide else np.uint8).astype(np.float64)


def _bytes(values: np.ndarray) -> np.ndarray:
    """The nearest whole numbers from 0 to 255, in place."""
    np.rint(values, out=values)
    np.maximum(values, 0, out=values)
    return np.minimum(values, 255, out=values)


def _restarts(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The pieces between restart markers from ``at`` on, without stuffing, and where the next other marker is."""
    pieces, first = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            pieces.append(data[first:])
            at = len(data)
            break
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif 0xD0 <= kind <= 0xD7:
            pieces.append(data[first:at])
            at += 2
            first = at
        elif kind == 0xFF:
            at += 1
        else:
            pieces.append(data[first:at])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in pieces], at


class _Scan:
    """Decodes the blocks of one scan; ``low`` and ``high`` are its bit positions of successive approximation."""

    def __init__(self, first: int, last: int, high: int, low: int) -> None:
        self.first, self.last, self.high, self.low = first, last, high, low
        self.restart()

    def restart(self) -> None:
        self.means: dict[int, int] = {}
        self.idle = 0  # blocks for which nothing more comes

    def whole(self, bits: _Bits, values: array, at: int, which: int, dc: tuple, ac: tuple) -> None:
        self.mean(bits, values, at, which, dc, ac)
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise JpgError("bad run in JPG")
                values[at + k] = bits.signed(size)
                k += 1
            elif run == 15:
                k += 16
            else:
                break

    def mean(self, bits: _Bits, values: array, at: int, which: int, dc: tuple, ac: tuple) -> None:
        self.means[which] = self.means.get(which, 0) + bits.signed(bits.symbol(dc) & 15)
        values[at] = self.means[which] << self.low

    def mean_bit(self, bits: _Bits, values: array, at: int, which: int, dc: tuple, ac: tuple) -> None:
        values[at] |= bits.take(1) << self.low

    def band(self, bits: _Bits, values: array, at: int, which: int, dc: tuple, ac: tuple) -> None:
        if self.idle:
            self.idle -= 1
            return
        k = self.first
        while k <= self.last:
            s = bits.symbol(ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise JpgError("bad run in JPG")
                values[at + k] = bits.signed(size) * (1 << self.low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.idle = (1 << run) + bits.take(run) - 1
                break

    def band_bit(self, bits: _Bits, values: array, at: int, which: int, dc: tuple, ac: tuple) -> None:
        step, k = 1 << self.low, self.first

        def refine(k: int) -> None:
            v = values[at + k]
            if bits.take(1) and not abs(v) & step:
                values[at + k] = v + step if v > 0 else v - step

        while not self.idle and k <= self.last:
            s = bits.symbol(ac)
            run, size = s >> 4, s & 15
            new = (step if bits.take(1) else -step) if size else 0
            if not size and run < 15:
                self.idle = (1 << run) + bits.take(run)
                break
            # ``run`` places that are still zero pass by; those that are not are refined on the way.
            while k <= self.last:
                if values[at + k]:
                    refine(k)
                elif run:
                    run -= 1
                else:
                    if new:
                        values[at + k] = new
                    k += 1
                    break
                k += 1
        if self.idle:
            for j in range(k, self.last + 1):
                if values[at + j]:
                    refine(j)
            self.idle -= 1

    def step(self, progressive: bool) -> Callable:
        if not progressive:
            return self.whole
        if self.first == 0:
            return self.mean_bit if self.high else self.mean
        return self.band_bit if self.high else self.band


class _Reader:
    def __init__(self, data: bytes, cosines: np.ndarray, order: np.ndarray) -> None:
        self.data, self.cosines, self.order = data, cosines, order
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, tuple[int, list[int]]] = {}
        self.planes: dict[int, _Plane] = {}
        self.width = self.height = self.interval = 0
        self.progressive, self.adobe, self.scans = False, -1, 0

    def read(self) -> np.ndarray:
        at, data = 2, self.data
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise JpgError("bad JPG segment")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            if kind == 0x01 or 0xD0 <= kind <= 0xD7:
                at += 2
                continue
            (size,) = struct.unpack(">H", data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise JpgError("JPG ends within a segment")
            at += 2 + size
            if kind == 0xDB:
                self.read_quantisers(body)
            elif kind == 0xC4:
                self.read_codes(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self.read_frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise JpgError("unsupported kind of JPG")
            elif kind == 0xDD:
                (self.interval,) = struct.unpack(">H", body[:2])
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif kind == 0xDA:
                pieces, at = _restarts(data, at)
                self.read_scan(body, pieces)
        if not self.planes or not self.scans:
            raise JpgError("no image in JPG")
        return self.pixels()

    def read_quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            size = 128 if wide else 64
            if len(body) <= size:
                raise JpgError("bad quantiser in JPG")
            self.quantisers[body[0] & 15] = _quantiser(body[1 : 1 + size], wide > 0)
            body = body[1 + size :]

    def read_codes(self, body: bytes) -> None:
        while len(body) >= 17:
            n = sum(body[1:17])
            self.codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def read_frame(self, body: bytes, progressive: bool) -> None:
        if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
            raise JpgError("unsupported kind of JPG")
        self.height, self.width = struct.unpack(">HH", body[1:5])
        self.progressive = progressive
        self.planes = {body[k]: _Plane(body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        if not self.width or not self.height or self.width * self.height > MOST_PIXELS or len(self.planes) not in (1, 3, 4):
            raise JpgError("unsupported size of JPG")
        if not all(0 < p.across < 5 and 0 < p.down < 5 for p in self.planes.values()):
            raise JpgError("bad sampling in JPG")
        self.across, self.down = max(p.across for p in self.planes.values()), max(p.down for p in self.planes.values())
        self.units = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        for p in self.planes.values():
            p.wide = -(-(-(-self.width * p.across // self.across)) // 8)
            p.high = -(-(-(-self.height * p.down // self.down)) // 8)
            p.stride = self.units[0] * p.across
            p.values = array("q", bytes(8 * 64 * p.stride * self.units[1] * p.down))

    def read_scan(self, body: bytes, pieces: list[bytes]) -> None:
        n = body[0] if body else 0
        if not self.planes or not n or len(body) < 4 + 2 * n:
            raise JpgError("bad scan in JPG")
        try:
            parts = [(k, self.planes[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
        except KeyError:
            raise JpgError("bad scan in JPG") from None
        first, last, both = body[1 + 2 * n : 4 + 2 * n]
        if not self.progressive:
            first, last, both = 0, 63, 0
        if last > 63 or first > last:
            raise JpgError("bad scan in JPG")
        scan = _Scan(first, last, both >> 4, both & 15)
        step = scan.step(self.progressive)
        codes = [(k, p, self.codes.get(t >> 4, (0, [])), self.codes.get(16 | t & 15, (0, []))) for k, p, t in parts]
        alone = codes[0][1] if n == 1 else None
        total = alone.wide * alone.high if alone else self.units[0] * self.units[1]
        piece, bits = 0, _Bits(pieces[0])
        try:
            for unit in range(total):
                if self.interval and unit and unit % self.interval == 0:
                    bits.check_end()
                    piece += 1
                    if piece >= len(pieces):
                        raise JpgError("JPG ends within a scan")
                    bits = _Bits(pieces[piece])
                    scan.restart()
                if alone:
                    y, x = divmod(unit, alone.wide)
                    step(bits, alone.values, 64 * (y * alone.stride + x), 0, *codes[0][2:])
                else:
                    y, x = divmod(unit, self.units[0])
                    for k, p, dc, ac in codes:
                        for j in range(p.down):
                            row = (y * p.down + j) * p.stride + x * p.across
                            for i in range(p.across):
                                step(bits, p.values, 64 * (row + i), k, dc, ac)
        except IndexError:
            raise JpgError("bad scan in JPG") from None
        bits.check_end()
        self.scans += 1

    def samples(self, alike: list[_Plane]) -> np.ndarray:
        """Samples of components of one sampling, plane by plane, scaled up to the size of the image."""
        p = alike[0]
        if any(a.quantiser not in self.quantisers for a in alike):
            raise JpgError("no quantiser in JPG")
        natural = np.empty((len(alike), len(p.values) // 64, 64))
        for rows, a in zip(natural, alike, strict=True):
            rows[:, self.order] = np.frombuffer(a.values, np.int64).reshape(-1, 64) * self.quantisers[a.quantiser]
        blocks = self.cosines.T @ natural.reshape(-1, 8, 8) @ self.cosines
        high = natural.shape[1] // p.stride
        whole = blocks.reshape(len(alike), high, p.stride, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(alike), 8 * high, 8 * p.stride)
        # The samples that the image has, without the padding of blocks; between their centres lines are drawn.
        whole = whole[:, : -(-self.height * p.down // self.down), : -(-self.width * p.across // self.across)] + 128
        for axis, size, part, most in ((1, self.height, p.down, self.down), (2, self.width, p.across, self.across)):
            if part != most:
                at = np.clip((np.arange(size) + 0.5) * part / most - 0.5, 0, whole.shape[axis] - 1)
                low = at.astype(int)
                high = np.minimum(low + 1, whole.shape[axis] - 1)
                share = (at - low)[:, None] if axis == 1 else at - low
                whole = whole.take(low, axis) * (1 - share) + whole.take(high, axis) * share
        return _bytes(whole)

    def pixels(self) -> np.ndarray:
        parts = list(self.planes.values())
        alike = len({(p.across, p.down) for p in parts}) == 1 and len(parts) * len(parts[0].values) <= TOGETHER
        planes = list(self.samples(parts)) if alike else [self.samples([p])[0] for p in parts]
        names = bytes(self.planes)
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        if self.adobe == 0 or (self.adobe < 0 and (names == b"RGB" or len(planes) == 4)):
            rgb = np.stack(planes[:3], 2)
        else:
            y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.empty((*y.shape, 3))
            rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2] = y + 1.402 * red, y - 0.344136286 * blue - 0.714136286 * red, y + 1.772 * blue
            _bytes(rgb)
        if len(planes) == 4:  # inks, which Adobe writes inverted
            ink = planes[3] if self.adobe >= 0 else 255 - planes[3]
            rgb = np.rint((rgb if self.adobe >= 0 else 255 - rgb) * ink[:, :, None] / 255)
        return rgb.astype(np.uint8)


def decode_jpg(data: bytes, cosines: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows x columns x RGB; ``cosines`` is the 8 x 8 transform and ``order`` where the file's k-th coefficient lies in it."""
    return _Reader(data, cosines, order).read()
