"""Codecs on numpy: PNG and JPG both ways (JPG is written as baseline), and sizes from PNG, JPG and WebP headers.

Arrays are rows x columns x channels of bytes, RGB or RGBA.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from .jpg_reader import JpgError, decode_jpg

PNG_SIGNATURE = bytes((137, 80, 78, 71, 13, 10, 26, 10))


class CodecError(ValueError):
    """Bytes that cannot be decoded."""


# ---- PNG ----


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    h, w, channels = pixels.shape
    rows = np.zeros((h, w * channels + 1), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the row filters; ``step`` is the bytes of a whole pixel (1 at least)."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            got, up = line.tolist(), above.tolist()
            for i in range(stride):
                a, b, c = (got[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got[i] = (got[i] + guess) & 255
            line = np.array(got, np.uint8)
        elif kind:
            raise CodecError("unknown row filter")
        out[y] = above = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """RGB or RGBA of any non-animated PNG."""
    if data[:8] != PNG_SIGNATURE:
        raise CodecError("no PNG signature")
    at, parts, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    if head is None or not parts:
        raise CodecError("no image in PNG")
    w, h, depth, color, _, _, interlace = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if samples is None or not w or not h:
        raise CodecError("bad PNG header")
    try:
        raw = zlib.decompress(b"".join(parts))
        bits = samples * depth
        step = max(1, bits // 8)
        values = np.zeros((h, w, samples), np.uint16)
        passes = [(0, 0, 1, 1)] if not interlace else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
        for x0, y0, dx, dy in passes:
            pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if pw <= 0 or ph <= 0:
                continue
            stride = (pw * bits + 7) // 8
            rows = _unfilter(raw, ph, stride, step)
            raw = raw[ph * (stride + 1) :]
            if depth == 8:
                got = rows.reshape(ph, pw, samples).astype(np.uint16)
            elif depth == 16:
                got = rows.reshape(ph, pw, samples, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
            else:
                single = np.unpackbits(rows, axis=1).reshape(ph, -1, depth)[:, : pw * samples]
                got = (single @ (1 << np.arange(depth - 1, -1, -1))).reshape(ph, pw, samples).astype(np.uint16)
            values[y0::dy, x0::dx] = got
    except (zlib.error, ValueError) as e:
        raise CodecError(str(e)) from e
    if color == 3:
        if palette is None or values.max() >= len(palette):
            raise CodecError("bad palette")
        out = palette[values[:, :, 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out = np.dstack([out, alpha[values[:, :, 0]]])
        return np.ascontiguousarray(out)
    see_through = None
    if clear is not None and color in (0, 2):
        key = np.array(struct.unpack(f">{samples}H", clear[: 2 * samples]), np.uint16)
        see_through = (values == key).all(axis=2)
    top = (1 << depth) - 1
    eight = (values >> 8 if depth == 16 else values * 255 // top).astype(np.uint8)
    if samples <= 2:
        eight = np.dstack([eight[:, :, 0]] * 3 + ([eight[:, :, 1]] if samples == 2 else []))
    if see_through is not None:
        eight = np.dstack([eight, np.where(see_through, 0, 255).astype(np.uint8)])
    return np.ascontiguousarray(eight)


# ---- JPG ----

# Quantisation of luminance and chrominance at quality 50, row by row.
_LUMINANCE = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
_CHROMINANCE = np.full((8, 8), 99)
_CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]


@lru_cache(maxsize=1)
def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block along its diagonals, in turns up and down."""
    cells = [(x + y, y if (x + y) % 2 else x, y * 8 + x) for y in range(8) for x in range(8)]
    return np.array([c[2] for c in sorted(cells)])


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def _quantisers(quality: int) -> list[np.ndarray]:
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return [np.clip((base * scale + 50) // 100, 1, 255) for base in (_LUMINANCE, _CHROMINANCE)]


@lru_cache(maxsize=128)
def _plane_quantisers(quality: int) -> np.ndarray:
    luminance, chrominance = _quantisers(quality)
    return np.stack([luminance, chrominance, chrominance])


def _code_lengths(counts: dict[int, int]) -> list[list[int]]:
    """Symbols by code length (1 to 16) for the given counts; no code is all ones."""
    import heapq

    items = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, (256,))]
    depth = dict.fromkeys([*counts, 256], 0)
    heapq.heapify(items)
    serial = 1 << 20
    while len(items) > 1:
        a, b = heapq.heappop(items), heapq.heappop(items)
        for s in a[2] + b[2]:
            depth[s] += 1
        serial += 1
        heapq.heappush(items, (a[0] + b[0], serial, a[2] + b[2]))
    per = [0] * (max(depth.values()) + 1)
    for d in depth.values():
        per[d] += 1
    for d in range(len(per) - 1, 16, -1):  # move pairs of too long codes up
        while per[d] > 0:
            j = d - 2
            while per[j] == 0:
                j -= 1
            per[d] -= 2
            per[d - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    per = (per + [0] * 17)[:17]
    longest = max(d for d in range(17) if per[d])
    per[longest] -= 1  # the code of all ones, held by symbol 256
    order = iter(sorted(counts, key=lambda s: (depth[s], s)))
    return [[next(order) for _ in range(per[d])] for d in range(1, 17)]


def _codes(lengths: list[list[int]]) -> dict[int, tuple[int, int]]:
    out, code = {}, 0
    for d, symbols in enumerate(lengths, 1):
        for s in symbols:
            out[s] = (code, d)
            code += 1
        code <<= 1
    return out


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that the size of each number needs, 0 for 0."""
    return np.frexp(np.abs(values))[1] * (values != 0)


def _events(rows: np.ndarray, planes: int) -> tuple[np.ndarray, ...]:
    """What a scan says, in order: (row, whether of its mean, symbol, extra bits, their number).

    ``rows`` are the coefficients of blocks in the order of the scan, ``planes`` blocks in turn.
    """
    n = len(rows)
    means = rows[:, 0].reshape(-1, planes)
    steps = np.diff(means, axis=0, prepend=np.zeros((1, planes), means.dtype)).ravel()
    at, k = np.nonzero(rows[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)], 0, np.concatenate([[0], k[:-1]])[: len(k)])
    run = k - before - 1
    values = rows[at, k]
    sizes = _bit_lengths(values)
    long_runs = np.repeat(np.arange(len(at)), run // 16)
    last = np.zeros(n, int)
    np.maximum.at(last, at, k)
    ends = np.flatnonzero(last < 63)
    none = lambda x: np.zeros(len(x), int)
    parts = [
        # (place in the order, row, symbol, number)
        (np.arange(n) * 256, np.arange(n), _bit_lengths(steps), steps),
        (at[long_runs] * 256 + 2 * k[long_runs], at[long_runs], none(long_runs) + 0xF0, none(long_runs)),
        (at * 256 + 2 * k + 1, at, (run % 16) << 4 | sizes, values),
        (ends * 256 + 255, ends, none(ends), none(ends)),
    ]
    place, row, symbol, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    place, row, symbol, value = place[order], row[order], symbol[order], value[order]
    size = _bit_lengths(value)
    return row, place % 256 == 0, symbol, np.where(value < 0, value + (1 << size) - 1, value), size


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=128)
def _jpg_start(quality: int) -> bytes:
    """All that comes before the frame of a JPG."""
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [_segment(0xDB, bytes([t]) + bytes(q.reshape(64)[_zigzag()].astype(np.uint8))) for t, q in enumerate(_quantisers(quality))]
    return b"".join(out)


def _jpg_frame(width: int, height: int) -> bytes:
    return _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1)))


def _jpg_codes(kind: int, table: int, lengths: list[list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | table]) + bytes(map(len, lengths)) + bytes(s for symbols in lengths for s in symbols))


_JPG_SCAN = _segment(0xDA, bytes((3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0)))


@lru_cache(maxsize=4096)
def _flat_codes(kind: int, table: int, counts: tuple[tuple[int, int], ...]) -> tuple[bytes, dict[int, str]]:
    """The segment of the codes for these symbols and counts, and the bits of each symbol."""
    lengths = _code_lengths(dict(counts))
    return _jpg_codes(kind, table, lengths), {s: f"{code:0{size}b}" for s, (code, size) in _codes(lengths).items()}


@lru_cache(maxsize=4096)
def _flat_means(color: tuple[int, ...], quality: int) -> list[int] | None:
    """The coefficients of the means of a block of one colour, None if by rounding it has others."""
    r, g, b = (float(v) for v in color[:3])
    if len(color) == 4:
        a = color[3] / 255.0
        r, g, b = r * a, g * a, b * a
    y = 0.299 * r + 0.587 * g + 0.114 * b
    blocks = np.empty((3, 8, 8))
    blocks[0], blocks[1], blocks[2] = y - 128, (b - y) / 1.772, (r - y) / 1.402
    cosines = _cosines()
    found = np.rint(cosines @ blocks @ cosines.T / _plane_quantisers(quality)).astype(int).reshape(3, 64)
    return None if found[:, 1:].any() else found[:, 0].tolist()


def _flat_jpg(color: tuple[int, ...], width: int, height: int, quality: int) -> bytes | None:
    """What ``encode_jpg`` writes for an image of one colour, from one block, as all are alike; None if that has more than a mean."""
    means = _flat_means(color, quality)
    if means is None:
        return None
    n = -(-width // 8) * -(-height // 8)
    sizes = [abs(v).bit_length() for v in means]
    segments, first, later = [], [""] * 3, [""] * 3
    for kind in (0, 1):
        for table, planes in ((0, (0,)), (1, (1, 2))):
            # A mean is written as its step from the block before, so all but the first are 0; nothing else follows it.
            counts = {0: len(planes) * (n if kind else n - 1)}
            for k in planes if kind == 0 else ():
                counts[sizes[k]] = counts.get(sizes[k], 0) + 1
            segment, bits = _flat_codes(kind, table, tuple(sorted((s, c) for s, c in counts.items() if c)))
            segments.append(segment)
            for k in planes:
                if kind:
                    first[k], later[k] = first[k] + bits[0], later[k] + bits[0]
                else:
                    extra = means[k] + (1 << sizes[k]) - 1 if means[k] < 0 else means[k]
                    first[k], later[k] = bits[sizes[k]] + (f"{extra:0{sizes[k]}b}" if sizes[k] else ""), bits.get(0, "")
    scan = "".join(first) + "".join(later) * (n - 1)
    scan += "1" * (-len(scan) % 8)
    data = int(scan, 2).to_bytes(len(scan) // 8, "big").replace(b"\xff", b"\xff\x00")
    return b"".join((_jpg_start(quality), _jpg_frame(width, height), *segments, _JPG_SCAN, data, b"\xff\xd9"))


def encode_jpg(pixels: np.ndarray, quality: int = 50) -> bytes:
    """Baseline JPG without subsampling, with Huffman codes made for this image; alpha is laid over black."""
    if pixels.size and (pixels == pixels[:1, :1]).all():
        flat = _flat_jpg(tuple(pixels[0, 0].tolist()), pixels.shape[1], pixels.shape[0], quality)
        if flat is not None:
            return flat
    return _any_jpg(pixels, quality)


def _any_jpg(pixels: np.ndarray, quality: int) -> bytes:
    rgb = pixels[:, :, :3].astype(np.float64)
    if pixels.shape[2] == 4:
        rgb = rgb * (pixels[:, :, 3:4] / 255.0)
    h, w, _ = rgb.shape
    r, g, b = rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    tables, cosines, order = _quantisers(quality), _cosines(), _zigzag()
    coded = []
    for k, plane in enumerate(planes):
        padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge")
        blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        freq = cosines @ blocks @ cosines.T
        coded.append(np.rint(freq / tables[min(k, 1)]).astype(int).reshape(-1, 64)[:, order])
    row, is_mean, symbol, extra, extra_size = _events(np.stack(coded, 1).reshape(-1, 64), 3)
    color = (row % 3 > 0).astype(int)
    code, code_size, lengths = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), {}
    for c, mean in ((0, True), (1, False)):
        for t in (0, 1):
            mine = (is_mean == mean) & (color == t)
            counts = np.bincount(symbol[mine], minlength=256)
            lengths[c, t] = _code_lengths({int(x): int(counts[x]) for x in np.flatnonzero(counts)} or {0: 1})
            table = np.zeros((256, 2), np.int64)
            for x, pair in _codes(lengths[c, t]).items():
                table[x] = pair
            code[mine], code_size[mine] = table[symbol[mine]].T
    whole, size = code << extra_size | extra, code_size + extra_size
    which = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(which)) - 1
    bits = np.concatenate([whole[which] >> left & 1, np.ones(-len(which) % 8, np.int64)])
    scan = np.packbits(bits.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    codes = [_jpg_codes(c, t, by) for (c, t), by in lengths.items()]
    return b"".join((_jpg_start(quality), _jpg_frame(w, h), *codes, _JPG_SCAN, scan, b"\xff\xd9"))


# ---- sizes from headers ----


def jpg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            raise CodecError("bad JPG segment")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xDA)):
            at += 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise CodecError("no frame in JPG")


def webp_size(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    raise CodecError("no image in WebP")


def sniff(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpg"
    if data[:3] == b"\x89PN":
        return "png"
    if data[:4] == b"RIFF" and len(data) >= 12 and data[8:12] == b"WEBP":
        return "webp"
    return None


def header_size(data: bytes) -> tuple[int, int]:
    kind = sniff(data)
    if kind == "png" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if kind == "jpg":
        return jpg_size(data)
    if kind == "webp":
        return webp_size(data)
    raise CodecError("unsupported_type")


def decode(data: bytes) -> np.ndarray:
    """Pixels of bytes in a column: PNG and JPG."""
    kind = sniff(data)
    if kind == "png":
        return decode_png(data)
    if kind == "jpg":
        try:
            return decode_jpg(data, _cosines(), _zigzag())
        except JpgError as e:
            raise CodecError(str(e)) from None
    raise CodecError("decode_failed")


def encode(pixels: np.ndarray, kind: str, quality: int | None = None) -> bytes:
    if kind == "png":
        return encode_png(pixels)
    if kind == "jpg":
        return encode_jpg(pixels, 50 if quality is None or quality < 0 else quality)
    raise CodecError("unsupported_target")
