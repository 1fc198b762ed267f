"""Lossless WebP (VP8L): a decoder for the whole format and two encoders.

`decode` reads any lossless file: prefix codes, meta prefix groups, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and colour-indexing transforms. `encode` writes an ARGB array with chosen transforms.
`encode_samples` and `decode_samples` are the batch forms that the media column uses: byte strings become the green
samples of an image 64 pixels wide, in frames of 64 rows, through a palette, prefix codes of their own and
back-references; many frames are decoded in step, a symbol of each at a time, as numpy operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
WIDTH, ROWS = 64, 64  # of a frame of samples
SIDE = 16384  # of a still image at most

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class WebPError(ValueError):
    pass


# --- bits and prefix codes ------------------------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data + b"\0" * 8, pos
        self.end = 8 * len(data)

    def peek(self) -> int:
        """56 bits or more from here."""
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)

    def read(self, n: int) -> int:
        got = self.peek() & ((1 << n) - 1)
        self.pos += n
        if self.pos > self.end:
            raise WebPError("the stream ends early")
        return got


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


_REVERSED: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """i with its n bits in reverse, for all i below 2^n."""
    if n not in _REVERSED:
        out = np.zeros(1, np.int64)
        for k in range(n):
            out = np.concatenate([out * 2, out * 2 + 1])
        _REVERSED[n] = out
    return _REVERSED[n]


class PrefixCode:
    """table[bits] = symbol * 16 + length, for the next `width` bits of the stream."""

    def __init__(self, lengths: np.ndarray):
        used = np.nonzero(lengths)[0]
        if len(used) == 1:  # takes no bits
            self.width, self.table = 0, np.array([used[0] * 16], np.int32)
            self.flat = self.table.tolist()
            return
        if not len(used):
            raise WebPError("a prefix code without symbols")
        own = lengths[used].astype(np.int64)
        self.width = int(own.max())
        order = np.argsort(own, kind="stable")
        spread = 1 << (self.width - own[order])
        if spread.sum() != 1 << self.width:
            raise WebPError("a prefix code isn't complete")
        by_code = np.repeat((used[order] * 16 + own[order]).astype(np.int32), spread)
        self.table = by_code[reversed_bits(self.width)]
        self.flat = None

    def read(self, bits: BitReader) -> int:
        if self.flat is None:
            self.flat = self.table.tolist()
        got = self.flat[bits.peek() & ((1 << self.width) - 1)]
        bits.pos += got & 15
        return got >> 4


_SHORT: dict[tuple[int, ...], PrefixCode] = {}


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("a symbol beyond the alphabet")
        lengths[symbols] = 1
        key = (alphabet, *sorted(set(symbols)))
        if key not in _SHORT:
            _SHORT[key] = PrefixCode(lengths)
        return _SHORT[key]
    meta = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        meta[LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last, out = 0, 8, []
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            out.append(s)
            at += 1
            if s:
                last = s
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise WebPError("code lengths run past the alphabet")
        out += [value] * n
        at += n
    lengths[: len(out)] = out
    return PrefixCode(lengths)


def expand(prefix: int, bits: BitReader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def shrink(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number and value of the extra bits of a length or distance code."""
    x = value - 1
    if x < 4:
        return x, 0, 0
    high = x.bit_length() - 1
    return 2 * high + (x >> (high - 1) & 1), high - 1, x & ((1 << (high - 1)) - 1)


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- decoding -------------------------------------------------------------------------------------------------------


def _read_group(bits: BitReader, cache_bits: int) -> list[PrefixCode]:
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    return [read_code(bits, n) for n in sizes]


def _read_cache_bits(bits: BitReader) -> int:
    if not bits.read(1):
        return 0
    n = bits.read(4)
    if not 1 <= n <= 11:
        raise WebPError("colour cache size")
    return n


def _read_pixels(bits: BitReader, width: int, height: int, cache_bits: int, groups: list[list[PrefixCode]], meta: list[int] | None, meta_bits: int) -> np.ndarray:
    total, out = width * height, []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, cached, tiles = 32 - cache_bits, 0, -(-width >> meta_bits) if meta else 0
    green, red, blue, alpha, dist = groups[0]
    while len(out) < total:
        if meta:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, dist = groups[meta[(y >> meta_bits) * tiles + (x >> meta_bits)]]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n = expand(s - 256, bits)
            d = distance(expand(dist.read(bits), bits), width)
            if d > len(out) or len(out) + n > total:
                raise WebPError("a back-reference outside the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            for v in out[cached:]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
            cached = len(out)
            out.append(cache[s - LITERALS - LENGTHS])
    if bits.pos > bits.end:
        raise WebPError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _read_sub_image(bits: BitReader, width: int, height: int) -> np.ndarray:
    cache_bits = _read_cache_bits(bits)
    return _read_pixels(bits, width, height, cache_bits, [_read_group(bits, cache_bits)], None, 0)


def _tiles(width: int, bits: int) -> int:
    return -(-width >> bits)


def _read_transforms(bits: BitReader, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms in stream order with the width before each, and the coded width."""
    out: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in out):
            raise WebPError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            out.append((kind, width, size, _read_sub_image(bits, _tiles(width, size), _tiles(height, size))))
        elif kind == SUBTRACT_GREEN:
            out.append((kind, width))
        else:
            n = bits.read(8) + 1
            deltas = _read_sub_image(bits, n, 1).reshape(n, 1).view(np.uint8).reshape(n, 4)
            palette = np.zeros(256, np.uint32)
            palette[:n] = np.cumsum(deltas, axis=0, dtype=np.uint8).copy().view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            out.append((kind, width, pack, palette))
            width = _tiles(width, pack)
    return out, width


def _open(data: bytes) -> tuple[BitReader, int, int]:
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise WebPError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("VP8L version")
    return bits, width, height


def decode_vp8l(data: bytes) -> np.ndarray:
    """The ARGB pixels (height x width, uint32) of a VP8L stream."""
    bits, width, height = _open(data)
    transforms, coded = _read_transforms(bits, width, height)
    cache_bits = _read_cache_bits(bits)
    meta, meta_bits, groups = None, 0, 1
    if bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = ((_read_sub_image(bits, _tiles(coded, meta_bits), _tiles(height, meta_bits)) >> 8) & 0xFFFF).ravel().tolist()
        groups = max(meta) + 1
    codes = [_read_group(bits, cache_bits) for _ in range(groups)]
    return invert(transforms, _read_pixels(bits, coded, height, cache_bits, codes, meta, meta_bits))


def _planes(argb: np.ndarray) -> np.ndarray:
    """Channels blue, green, red, alpha along the last axis."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)


def _half(a, b):
    return (a.astype(np.int16) + b) // 2


def _predict(mode: int, left, top, top_right, top_left):
    """Prediction of channels (int16 arrays) by mode."""
    if mode == 0 or mode > 13:
        out = np.zeros_like(top)
        out[..., 3] = 255
        return out
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        toward = np.abs(top - top_left).sum(axis=-1, keepdims=True) < np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(toward, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        middle = _half(left, top)
        step = middle - top_left
        return np.clip(middle + np.sign(step) * (np.abs(step) // 2), 0, 255)
    pairs = {6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}
    return _half(*pairs[mode]) if mode in pairs else {1: left, 2: top, 3: top_right, 4: top_left}[mode]


def _neighbours(px: np.ndarray, y: int, x: slice | int):
    """left, top, top right and top left of pixels in row y > 0, columns x > 0; the last column's top right is its own row's first."""
    h, w, _ = px.shape
    a, b = (x, x + 1) if isinstance(x, int) else (x.start, x.stop)
    right = px[y - 1, a + 1 : b + 1] if b < w else np.concatenate([px[y - 1, a + 1 : w], px[y, :1]])
    got = px[y, a - 1 : b - 1], px[y - 1, a:b], right, px[y - 1, a - 1 : b - 1]
    return tuple(v[0] for v in got) if isinstance(x, int) else got


def _unpredict(argb: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    px = _planes(argb).astype(np.int16)
    h, w, _ = px.shape
    modes = ((modes >> 8) & 15).astype(int)
    px[0, 0, 3] += 255
    px[0] = np.cumsum(px[0], axis=0) & 255
    for y in range(1, h):
        px[y, 0] = (px[y, 0] + px[y - 1, 0]) & 255
        for tile in range(modes.shape[1]):
            a, b = max(1, tile << size), min(w, (tile + 1) << size)
            if a >= b:
                continue
            mode = modes[y >> size, tile]
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:  # by the row above alone
                px[y, a:b] = (px[y, a:b] + _predict(mode, *_neighbours(px, y, slice(a, b)))) & 255
            elif mode == 1:
                px[y, a:b] = np.cumsum(px[y, a - 1 : b], axis=0)[1:] & 255
            else:
                for x in range(a, b):
                    px[y, x] = (px[y, x] + _predict(mode, *_neighbours(px, y, x))) & 255
    return px.astype(np.uint8).copy().view(np.uint32)[..., 0]


def _colour_delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def _cross(px: np.ndarray, size: int, element: np.ndarray, sign: int) -> np.ndarray:
    """px (uint8 channels) with the cross-colour transform applied (sign -1) or inverted (+1)."""
    h, w, _ = px.shape
    e = np.repeat(np.repeat(_planes(element), 1 << size, axis=0), 1 << size, axis=1)[:h, :w]
    blue, green, red, alpha = (px[..., k] for k in range(4))
    new_red = (red.astype(np.int32) + sign * _colour_delta(e[..., 0], green)).astype(np.uint8)
    base = new_red if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * (_colour_delta(e[..., 1], green) + _colour_delta(e[..., 2], base))).astype(np.uint8)
    return np.stack([new_blue, green, new_red, alpha], axis=-1)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    px = px.copy()
    for k in (0, 2):
        px[..., k] = (px[..., k].astype(np.int16) + sign * px[..., 1].astype(np.int16)).astype(np.uint8)
    return px


def invert(transforms: list[tuple], argb: np.ndarray) -> np.ndarray:
    for kind, width, *args in reversed(transforms):
        if kind == PREDICTOR:
            argb = _unpredict(argb, *args)
        elif kind == CROSS_COLOUR:
            argb = np.ascontiguousarray(_cross(_planes(argb), *args, 1)).view(np.uint32)[..., 0]
        elif kind == SUBTRACT_GREEN:
            argb = np.ascontiguousarray(_green(_planes(argb), 1)).view(np.uint32)[..., 0]
        else:
            pack, palette = args
            index = (argb >> 8) & 255
            if pack:
                each = 8 >> pack
                index = np.stack([(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << pack)], axis=-1).reshape(len(index), -1)[:, :width]
            argb = palette[index]
    return argb


# --- the container --------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _three(n: int) -> bytes:
    return n.to_bytes(3, "little")


def wrap(frames: list[tuple[int, int, int, int, bytes]], width: int, height: int) -> bytes:
    """A file of VP8L frames (x, y, width, height, stream): a still image if one frame covers the canvas, else one with frames."""
    if len(frames) == 1 and frames[0][:4] == (0, 0, width, height):
        body = _chunk(b"VP8L", frames[0][4])
    else:
        parts = [_chunk(b"VP8X", b"\x12\0\0\0" + _three(width - 1) + _three(height - 1)), _chunk(b"ANIM", b"\0" * 6)]
        for x, y, w, h, stream in frames:
            parts.append(_chunk(b"ANMF", _three(x // 2) + _three(y // 2) + _three(w - 1) + _three(h - 1) + _three(0) + b"\x02" + _chunk(b"VP8L", stream)))
        body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise WebPError("a chunk runs past its file")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def unwrap(data: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    """Canvas width and height and the frames (x, y, stream) of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no WebP file")
    width = height = 0
    frames = []
    for name, a, b in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"VP8X":
            width, height = int.from_bytes(data[a + 4 : a + 7], "little") + 1, int.from_bytes(data[a + 7 : a + 10], "little") + 1
        elif name == b"VP8L":
            frames.append((0, 0, data[a:b]))
        elif name == b"ANMF":
            x, y = (2 * int.from_bytes(data[a + k : a + k + 3], "little") for k in (0, 3))
            frames += [(x, y, data[c:d]) for inner, c, d in _chunks(data, a + 16, b) if inner == b"VP8L"]
        elif name == b"VP8 ":
            raise WebPError("a lossy image")
    if not frames:
        raise WebPError("no lossless image")
    if not width:
        _, width, height = _open(frames[0][2])
    return width, height, frames


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless file; frames are laid on the canvas in turn."""
    width, height, frames = unwrap(data)
    canvas = np.zeros((height, width), np.uint32)
    for x, y, stream in frames:
        px = decode_vp8l(stream)
        canvas[y : y + px.shape[0], x : x + px.shape[1]] = px
    return canvas


# --- code lengths ---------------------------------------------------------------------------------------------------

MAX_BITS = 15  # the format's
#: The lengths' own code, the same in every stream: 13 symbols of four bits, six of five.
META_LENGTHS = np.array([4, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 4, 4, 4], np.uint8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths (rows x symbols) of complete prefix codes for rows of counts; a row with one symbol gives it length 1.

    -log2 of the smoothed share, rounded up, leaves room in the code; passes over the symbols, shortest codes first,
    shorten codes while room is left. The longest code's share divides the room, so a pass always uses some of it.
    """
    rows = len(counts)
    used = counts > 0
    n = used.sum(axis=1, keepdims=True)
    share = 0.85 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 0.15 / np.maximum(n, 1)
    lengths = np.where(used, np.clip(np.ceil(-np.log2(share)), 1, MAX_BITS), 0).astype(np.int64)
    room = (1 << MAX_BITS) - np.where(used, 1 << (MAX_BITS - lengths), 0).sum(axis=1)
    room[n[:, 0] < 2] = 0
    order = np.argsort(np.where(used, -counts, 1), axis=1, kind="stable")[:, : int(n.max(initial=0))]
    sorted_ = np.take_along_axis(lengths, order, axis=1)
    while (room > 0).any():
        for k in range(sorted_.shape[1]):
            own = sorted_[:, k]
            cost = np.where(own > 1, 1 << (MAX_BITS - own), 1 << 30)
            fits = cost <= room
            if fits.any():
                room = room - np.where(fits, cost, 0)
                sorted_[:, k] = own - fits
    np.put_along_axis(lengths, order, sorted_, axis=1)
    return np.where(used, lengths, 0).reshape(rows, -1)


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of one row of lengths, bits in stream order."""
    out = np.zeros(len(lengths), np.int64)
    used = np.nonzero(lengths)[0]
    if len(used) < 2:
        return out
    own = lengths[used].astype(np.int64)
    order = np.argsort(own, kind="stable")
    width = int(own.max())
    start = np.cumsum(1 << (width - own[order])) - (1 << (width - own[order]))
    out[used[order]] = reversed_bits(width)[start]  # the low bits of the reverse are those of the code itself
    return out


_META_CODES = codes(META_LENGTHS)


def write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    """The description of a code; one without symbols or with one alone takes the short form where it can."""
    used = np.nonzero(lengths)[0].tolist()
    if not used or (len(used) <= 2 and used[-1] < 256):
        symbols = used or [0]
        bits.write(1 | (len(symbols) - 1) << 1 | 1 << 2 | symbols[0] << 3, 11)
        if len(symbols) == 2:
            bits.write(symbols[1], 8)
        return
    bits.write(0, 1)
    bits.write(15, 4)
    for k in LENGTH_ORDER:
        bits.write(int(META_LENGTHS[k]), 3)
    tokens: list[tuple[int, int, int]] = []
    at, own = 0, lengths[: used[-1] + 1].tolist()
    while at < len(own):
        if own[at]:
            tokens.append((own[at], 0, 0))
            at += 1
            continue
        to = at
        while not own[to]:
            to += 1
        gap = to - at
        while gap:
            if gap < 3:
                tokens.append((0, 0, 0))
                gap -= 1
            elif gap < 11:
                tokens.append((17, gap - 3, 3))
                gap = 0
            else:
                n = min(gap, 138)
                tokens.append((18, n - 11, 7))
                gap -= n
        at = to
    wide = max(1, -(-max(1, (len(tokens) - 2).bit_length()) // 2))
    if len(tokens) < 2:
        tokens.append((0, 0, 0))
    bits.write(1 | (wide - 1) << 1, 4)
    bits.write(len(tokens) - 2, 2 * wide)
    for s, extra, n in tokens:
        bits.write(int(_META_CODES[s]), int(META_LENGTHS[s]))
        if n:
            bits.write(extra, n)


# --- encoding an ARGB array -----------------------------------------------------------------------------------------


def _write_pixels(bits: BitWriter, argb: np.ndarray, cache_bits: int = 0, meta: np.ndarray | None = None, meta_bits: int = 2) -> None:
    """Codes and pixels of an entropy-coded image; matches of three pixels or more become back-references."""
    h, w = argb.shape
    px, tiles = argb.ravel().tolist(), _tiles(w, meta_bits)
    group_of = (lambda i: int(meta[(i // w) >> meta_bits, (i % w) >> meta_bits])) if meta is not None else (lambda i: 0)
    groups = int(meta.max()) + 1 if meta is not None else 1
    tokens: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # group, (code, symbol, extra, extra bits)
    cache, seen, i = [None] * (1 << cache_bits), {}, 0
    slot = lambda v: (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        n, d = 0, 0
        if (j := seen.get(tuple(px[i : i + 3]))) is not None:
            d = i - j
            while i + n < len(px) and n < 4096 and px[i + n] == px[i + n - d]:
                n += 1
        if n >= 3:
            code = 2 if d == 1 else 1 if d == w else d + 120
            (s, k, x), (s2, k2, x2) = shrink(n), shrink(code)
            tokens.append((group_of(i), [(0, 256 + s, x, k), (4, s2, x2, k2)]))
        elif cache_bits and cache[slot(px[i])] == px[i]:
            n = 1
            tokens.append((group_of(i), [(0, LITERALS + LENGTHS + slot(px[i]), 0, 0)]))
        else:
            n, v = 1, px[i]
            tokens.append((group_of(i), [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]))
        for p in range(i, i + n):
            seen[tuple(px[p : p + 3])] = p
            if cache_bits:
                cache[slot(px[p])] = px[p]
        i += n
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[np.zeros((1, n), np.int64) for n in sizes] for _ in range(groups)]
    for g, parts in tokens:
        for c, s, _, _ in parts:
            counts[g][c][0, s] += 1
    lengths = [[code_lengths(c)[0] for c in row] for row in counts]
    for row in lengths:
        for one in row:
            write_code(bits, one)
    book = [[(codes(one), np.where(np.count_nonzero(one) > 1, one, 0)) for one in row] for row in lengths]
    for g, parts in tokens:
        for c, s, extra, n in parts:
            bits.write(int(book[g][c][0][s]), int(book[g][c][1][s]))
            bits.write(extra, n)


def _write_sub_image(bits: BitWriter, argb: np.ndarray) -> None:
    bits.write(0, 1)
    _write_pixels(bits, argb)


def encode(argb: np.ndarray, transforms: tuple[tuple, ...] = (), cache_bits: int = 0, meta: np.ndarray | None = None, meta_bits: int = 2) -> bytes:
    """A still file of ARGB pixels. transforms, in the order in which they are applied: (PREDICTOR, size bits, modes),
    (CROSS_COLOUR, size bits, elements), (SUBTRACT_GREEN,), (INDEXING,). meta gives each tile of 2^meta_bits its prefix
    group. Colour indexing needs at most 256 colours."""
    h, w = argb.shape
    if not (1 <= h <= SIDE and 1 <= w <= SIDE):
        raise WebPError("image size")
    bits = BitWriter()
    bits.write(0x2F | (w - 1) << 8 | (h - 1) << 22 | 1 << 36, 40)
    for kind, *args in transforms:
        bits.write(1 | kind << 1, 3)
        if kind == PREDICTOR:
            size, modes = args
            bits.write(size - 2, 3)
            _write_sub_image(bits, (modes.astype(np.uint32) << 8) | np.uint32(0xFF000000))
            px, out = _planes(argb).astype(np.int16), _planes(argb).astype(np.int16)
            out[0, 0, 3] -= 255
            out[0, 1:] -= px[0, :-1]
            for y in range(1, h):
                out[y, 0] -= px[y - 1, 0]
                for x in range(1, w):
                    out[y, x] -= _predict(int(modes[y >> size, x >> size]), *_neighbours(px, y, x))
            argb = (out & 255).astype(np.uint8).copy().view(np.uint32)[..., 0]
        elif kind == CROSS_COLOUR:
            size, elements = args
            bits.write(size - 2, 3)
            _write_sub_image(bits, elements)
            argb = np.ascontiguousarray(_cross(_planes(argb), size, elements, -1)).view(np.uint32)[..., 0]
        elif kind == SUBTRACT_GREEN:
            argb = np.ascontiguousarray(_green(_planes(argb), -1)).view(np.uint32)[..., 0]
        else:
            palette, index = np.unique(argb, return_inverse=True)
            if len(palette) > 256:
                raise WebPError("more than 256 colours")
            bits.write(len(palette) - 1, 8)
            steps = np.diff(_planes(palette), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_sub_image(bits, np.ascontiguousarray(steps).view(np.uint32).reshape(1, -1))
            argb = _bundle(index.reshape(h, w), len(palette)).astype(np.uint32) << 8 | np.uint32(0xFF000000)
    bits.write(0, 1)
    bits.write(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    bits.write(meta is not None, 1)
    if meta is not None:
        meta = meta[:, : _tiles(argb.shape[1], meta_bits)]  # colour indexing may have made the image narrower
        bits.write(meta_bits - 2, 3)
        _write_sub_image(bits, (meta.astype(np.uint32) << 8) | np.uint32(0xFF000000))
    _write_pixels(bits, argb, cache_bits, meta, meta_bits)
    return wrap([(0, 0, w, h, bits.bytes())], w, h)


def _bundle(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indices (rows x width), several to a pixel if the palette is small."""
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, n = 8 >> pack, 1 << pack
    if not pack:
        return index
    wide = np.zeros((len(index), -(-index.shape[1] // n) * n), np.int64)
    wide[:, : index.shape[1]] = index
    return (wide.reshape(len(index), -1, n) << (each * np.arange(n))).sum(axis=2)


# --- samples in batches ---------------------------------------------------------------------------------------------

MATCH = 8  # bytes from which a repeat is sought
SYMBOLS = LITERALS + LENGTHS


def _matches(flat: np.ndarray, frame: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (position, length, distance) in flat, without overlaps, each within its frame. Positions are
    sampled by content; a repeat is found at the last position before it with the same MATCH bytes."""
    none = (np.array([], np.int64),) * 3
    if len(flat) < 2 * MATCH:
        return none
    raw = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.ndarray((len(flat),), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        mixed = words * np.uint64(0x9E3779B97F4A7C15)
    at = np.nonzero((mixed >> np.uint64(61)) == 0)[0]
    at = at[at + MATCH <= ends[frame[at]]]
    order = at[np.lexsort((words[at], frame[at]))]
    same = (words[order][1:] == words[order][:-1]) & (frame[order][1:] == frame[order][:-1])
    here, prev = order[1:][same], order[:-1][same]
    if not len(here):
        return none
    back = np.argsort(here)
    here, prev = here[back], prev[back]
    most = ends[frame[here]] - here
    length = np.full(len(here), MATCH)
    going = np.arange(len(here))
    while len(going):  # eight bytes more at a time
        a, b = here[going] + length[going], prev[going] + length[going]
        ok = length[going] + 8 <= most[going]
        ok[ok] = words[a[ok]] == words[b[ok]]
        going = going[ok]
        length[going] += 8
    pick, reach = [], 0
    for k, (p, n) in enumerate(zip(here.tolist(), length.tolist())):
        if p >= reach:
            pick.append(k)
            reach = p + n
    return here[pick], length[pick], (here - prev)[pick]


def _shrink_all(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = values - 1
    high = np.where(x >= 4, np.floor(np.log2(np.maximum(x, 1) + 0.5)).astype(np.int64), 2)
    small = x < 4
    return np.where(small, x, 2 * high + (x >> (high - 1) & 1)), np.where(small, 0, high - 1), np.where(small, 0, x & ((1 << (high - 1)) - 1))


def encode_samples(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a positive multiple of WIDTH: its bytes are the green samples. What is
    written for a payload depends on it alone."""
    coded, widths, palettes = [], [], []
    for p in payloads:
        if not p or len(p) % WIDTH:
            raise WebPError(f"samples come in rows of {WIDTH}")
        a = np.frombuffer(p, np.uint8)
        palette = np.nonzero(np.bincount(a, minlength=256))[0]
        lookup = np.zeros(256, np.uint8)
        lookup[palette] = np.arange(len(palette))
        index = _bundle(lookup[a].reshape(-1, WIDTH), len(palette)).astype(np.uint8)
        coded.append(index.ravel()), widths.append(index.shape[1]), palettes.append(palette)
    flat = np.concatenate(coded)
    sizes = np.array([len(c) for c in coded])
    doc_end = np.cumsum(sizes)
    per = np.array(widths) * ROWS
    n_frames = -(-sizes // per)
    frame_doc = np.repeat(np.arange(len(coded)), n_frames)
    nth = np.arange(len(frame_doc)) - np.repeat(np.cumsum(n_frames) - n_frames, n_frames)
    begin = (doc_end - sizes)[frame_doc] + nth * per[frame_doc]
    end = np.minimum(begin + per[frame_doc], doc_end[frame_doc])
    frame = np.repeat(np.arange(len(begin)), end - begin)
    pos, length, dist = _matches(flat, frame, end)
    # tokens: literals outside copies, and two for each copy
    covered = np.zeros(len(flat) + 1, np.int8)
    covered[pos] += 1
    np.subtract.at(covered, pos + length, 1)
    literal = np.nonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)[0]
    row = np.array(widths)[frame_doc[frame[pos]]] if len(pos) else pos
    s_len, n_len, x_len = _shrink_all(length)
    s_dist, n_dist, x_dist = _shrink_all(np.where(dist == 1, 2, np.where(dist == row, 1, dist + 120)))
    doc_lit, doc_copy = frame_doc[frame[literal]], frame_doc[frame[pos]]
    docs = len(coded)
    greens = np.bincount(np.concatenate([doc_lit * SYMBOLS + flat[literal], doc_copy * SYMBOLS + 256 + s_len]), minlength=docs * SYMBOLS).reshape(docs, SYMBOLS)
    dists = np.bincount(doc_copy * DISTANCES + s_dist, minlength=docs * DISTANCES).reshape(docs, DISTANCES)
    green_len, dist_len = code_lengths(greens), code_lengths(dists)
    green_code, dist_code = np.stack([codes(x) for x in green_len]), np.stack([codes(x) for x in dist_len])
    steps = [np.diff(p, prepend=0) for p in palettes]
    step_len = code_lengths(np.stack([np.bincount(x, minlength=SYMBOLS) for x in steps]))
    heads = [_samples_head(*x) for x in zip(steps, step_len, green_len, dist_len)]
    green_bits = np.where((green_len > 0).sum(axis=1, keepdims=True) == 1, 0, green_len)
    dist_bits = np.where((dist_len > 0).sum(axis=1, keepdims=True) == 1, 0, dist_len)
    g_sym = 256 + s_len
    key = np.concatenate([literal * 2, pos * 2, pos * 2 + 1])
    value = np.concatenate([green_code[doc_lit, flat[literal]], green_code[doc_copy, g_sym] | x_len << green_bits[doc_copy, g_sym], dist_code[doc_copy, s_dist] | x_dist << dist_bits[doc_copy, s_dist]])
    n_bits = np.concatenate([green_bits[doc_lit, flat[literal]], green_bits[doc_copy, g_sym] + n_len, dist_bits[doc_copy, s_dist] + n_dist])
    order = np.argsort(key, kind="stable")
    value, n_bits, token_frame = value[order], n_bits[order], frame[key[order] >> 1]
    # every frame's stream starts on a word of 32 bits, behind its head
    head_bits = np.array([b for _, b in heads])[frame_doc]
    total = np.bincount(token_frame, weights=n_bits, minlength=len(begin)).astype(np.int64) + head_bits
    room = -(-total // 32)
    base = (np.cumsum(room) - room) * 32
    run = np.cumsum(n_bits) - n_bits
    first = np.searchsorted(token_frame, np.arange(len(begin)))
    spot = base[token_frame] + head_bits[token_frame] + run - np.append(run, 0)[first][token_frame]
    shifted = value.astype(np.uint64) << (spot & 31).astype(np.uint64)
    word = spot >> 5
    n_words = int(room.sum()) + 2
    out = np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words) + np.bincount(word + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n_words)
    stream = out.astype(np.uint64).astype("<u4").tobytes()
    files, at = [], 0
    for d in range(docs):
        head = heads[d][0]
        frames, rows = [], len(payloads[d]) // WIDTH
        for k in range(int(n_frames[d])):
            h = min(ROWS, rows - k * ROWS)
            a = int(base[at]) // 8
            size = -(-int(total[at]) // 8)
            body = int.from_bytes(stream[a : a + size], "little") | head | (h - 1) << 22
            frames.append((0, k * ROWS, WIDTH, h, body.to_bytes(size, "little")))
            at += 1
        files.append(wrap(frames, WIDTH, rows))
    return files


def _constant(*lengths: np.ndarray) -> tuple[int, int]:
    bits = BitWriter()
    for one in lengths:
        write_code(bits, one)
    return bits.value, bits.size


_NONE, _OPAQUE = np.zeros(256, np.uint8), np.eye(256, dtype=np.uint8)[255]
_STEPS = _constant(_NONE, _NONE, np.eye(256, dtype=np.uint8)[[0, 255]].sum(axis=0), _NONE[:DISTANCES])  # red, blue, alpha, distance
_ONE_STEP = _constant(_NONE, _NONE, _OPAQUE, _NONE[:DISTANCES])
_FLAT = _constant(_NONE, _NONE, _OPAQUE)


def _samples_head(steps: np.ndarray, own: np.ndarray, green: np.ndarray, dist: np.ndarray) -> tuple[int, int]:
    """Everything ahead of a frame's pixels but its height, as a number and its bits. steps: the palette's differences, own
    their code lengths; alpha is 255 at first and never changes."""
    bits = BitWriter()
    bits.write(0x2F | (WIDTH - 1) << 8 | 1 << 36, 40)
    bits.write(1 | INDEXING << 1 | (len(steps) - 1) << 3, 12)  # and no cache
    write_code(bits, own)
    bits.write(*(_STEPS if len(steps) > 1 else _ONE_STEP))
    book, sizes = codes(own).tolist(), np.where(np.count_nonzero(own) > 1, own, 0).tolist()
    value = size = 0
    for k, s in enumerate(steps.tolist()):
        value |= book[s] << size
        size += sizes[s]
        if len(steps) > 1:
            value |= (k == 0) << size
            size += 1
    bits.write(value, size)
    bits.write(0, 3)  # no more transforms, no cache, one prefix group
    write_code(bits, green)
    bits.write(*_FLAT)
    write_code(bits, dist)
    return bits.value, bits.size


class _Head:
    """A parsed stream up to its pixels."""

    def __init__(self, data: bytes):
        bits, self.width, self.height = _open(data)
        self.transforms, self.coded = _read_transforms(bits, self.width, self.height)
        cache_bits = _read_cache_bits(bits)
        meta = bits.read(1)
        self.plain = False
        if not cache_bits and not meta:
            self.codes = _read_group(bits, 0)
            # red, blue and alpha take no bits: a pixel is one green symbol
            self.plain = all(c.width == 0 for c in self.codes[1:4])
        self.bits = bits.pos
        self.mark = int.from_bytes(data[5 : -(-self.bits // 8)], "little") & ((1 << (self.bits - 40)) - 1)

    def same(self, data: bytes) -> bool:
        """Whether data's head is this one but for the image's size, the width being the same."""
        return data[:1] == b"\x2f" and (int.from_bytes(data[1:3], "little") & 0x3FFF) == self.width - 1 and int.from_bytes(data[5 : -(-self.bits // 8)], "little") & ((1 << (self.bits - 40)) - 1) == self.mark


LANES = 4096  # frames decoded in step


def decode_samples(files: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Width, height and green samples, row by row, of each file."""
    canvases, jobs, head = [], [], None
    for f, data in enumerate(files):
        width, height, frames = unwrap(data)
        canvases.append(np.zeros((height, width), np.uint8))
        for x, y, stream in frames:
            if head is None or not head.same(stream):
                head = _Head(stream)
            height = 1 + (int.from_bytes(stream[2:5], "little") >> 6 & 0x3FFF)
            if head.plain and all(t[0] == INDEXING for t in head.transforms):
                jobs.append((f, x, y, height, head, stream))
            else:
                px = decode_vp8l(stream)
                canvases[f][y : y + px.shape[0], x : x + px.shape[1]] = (px >> 8) & 255
    for at in range(0, len(jobs), LANES):
        part = jobs[at : at + LANES]
        for (f, x, y, h, head, _), index in zip(part, _in_step(part)):
            index = index.reshape(h, head.coded)
            if head.transforms:
                _, _, pack, palette = head.transforms[0]
                if pack:
                    each = 8 >> pack
                    index = np.stack([(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << pack)], axis=-1).reshape(h, -1)[:, : head.width]
                index = (palette.view(np.uint8)[1::4])[index]
            canvases[f][y : y + h, x : x + head.width] = index
    return [(c.shape[1], c.shape[0], c.tobytes()) for c in canvases]


def _in_step(jobs: list[tuple]) -> list[np.ndarray]:
    """Green samples of each job's frame. All frames advance by a symbol at a time; finished ones drop out now and then."""
    streams = [j[5] for j in jobs]
    raw = np.frombuffer(b"".join(s + b"\0" * 8 for s in streams) + b"\0" * 16, np.uint8)
    view = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    starts = np.cumsum([0] + [len(s) + 8 for s in streams[:-1]])
    heads, tables, size = {}, [], 0
    for j in jobs:
        if id(j[4]) not in heads:
            green = j[4].codes[0]
            heads[id(j[4])] = (size, (1 << green.width) - 1)
            tables.append(green.table)
            size += len(green.table)
    table = np.concatenate(tables)
    base = np.array([heads[id(j[4])][0] for j in jobs])
    mask = np.array([heads[id(j[4])][1] for j in jobs], np.uint64)
    need = np.array([j[3] * j[4].coded for j in jobs])
    width = int(need.max()) + 64
    out = np.zeros(len(jobs) * width, np.uint8)
    pos = (starts * 8 + np.array([j[4].bits for j in jobs])).astype(np.int64)
    at, lane = np.arange(len(jobs)) * width, np.arange(len(jobs))
    stop = at + need
    seven, low = np.uint64(7), np.int32(15)
    step = 0
    while len(lane):
        entry = table[base + ((view[pos >> 3] >> (pos.astype(np.uint64) & seven)) & mask).astype(np.int64)]
        pos += entry & low
        symbol = entry >> 4
        copies = np.nonzero(symbol > 255)[0]
        out[at] = symbol  # a copy writes over this
        at += 1
        for k in copies.tolist():
            begin = int(at[k]) - 1
            if begin >= stop[k]:
                continue
            own = int(lane[k])
            bits = BitReader(streams[own], int(pos[k] - starts[own] * 8))
            n = expand(int(symbol[k]) - 256, bits)
            d = distance(expand(jobs[own][4].codes[4].read(bits), bits), jobs[own][4].coded)
            if d > begin - own * width or begin + n > stop[k]:
                raise WebPError("a back-reference outside the image")
            if d >= n:
                out[begin : begin + n] = out[begin - d : begin - d + n]
            else:
                out[begin : begin + n] = np.resize(out[begin - d : begin], n)
            pos[k], at[k] = bits.pos + starts[own] * 8, begin + n
        step += 1
        done = at >= stop
        if step % 32 == 0 and done.any():
            keep = ~done
            pos, at, lane, stop, base, mask = (a[keep] for a in (pos, at, lane, stop, base, mask))
        elif done.any():  # stay where they are
            over = np.nonzero(done)[0]
            at[over] = np.maximum(stop[over], at[over] - 1)
    return [out[k * width : k * width + n] for k, n in enumerate(need.tolist())]
