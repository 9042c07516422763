"""Lossless WebP (VP8L): a decoder of single files for every feature of the format.

It reads prefix codes with their groups, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Pixels are arrays of shape (height,
width, 4), samples R, G, B, A. webp_batch reads and writes many small images at once.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120 are pixels nearby: by distance, then by columns, right before left.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_BACKWARD = [int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)]
#: The multiplier of the colour cache's hash. Fixed value of the format.
CACHE_HASH = 0x1E35A7BD


class WebPError(ValueError):
    pass


class _Bits:
    """Bits of data, the least significant of a byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > 8 * len(self.data):
            raise WebPError("the stream ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class _Code:
    """A prefix code of symbols and their lengths: a table over the bits that its longest code takes,
    of 16 * symbol + length."""

    def __init__(self, symbols: list[int], lengths: list[int]):
        if len(symbols) <= 1:
            self.bits, self.table = 0, [(symbols[0] if symbols else 0) << 4]
            return
        self.bits = max(lengths)
        self.table = [0] * (1 << self.bits)
        code, last = 0, 0
        for n, s in sorted(zip(lengths, symbols, strict=True)):
            code <<= n - last
            last = n
            if code >> n:
                raise WebPError("a prefix code is overfull")
            self.table[_BACKWARD[code] >> (15 - n) :: 1 << n] = [s << 4 | n] * (1 << (self.bits - n))
            code += 1
        if code != 1 << self.bits:
            raise WebPError("a prefix code is incomplete")

    def next(self, bits: _Bits) -> int:
        found = self.table[bits.peek(self.bits)]
        bits.read(found & 15)
        return found >> 4


def read_lengths(bits: _Bits, size: int) -> tuple[list[int], list[int]]:
    """The symbols that a prefix code of the stream has, in order, and the lengths of their codes."""
    word = bits.peek(19)
    if word & 1:  # one symbol, of one bit or eight, or two
        wide = 8 if word & 4 else 1
        symbols = [word >> 3 & ((1 << wide) - 1)]
        if word & 2:
            symbols = sorted({*symbols, word >> (3 + wide) & 255})
        bits.read(3 + wide + (8 if word & 2 else 0))
        if max(symbols) >= size:
            raise WebPError("a symbol lies outside its alphabet")
        return symbols, [1] * len(symbols)
    bits.read(1)
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[_LENGTH_ORDER[i]] = bits.read(3)
    code = _token_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbols, lengths = [], []
    done, last, table, mask, at, data, number = 0, 8, code.table, (1 << code.bits) - 1, bits.at, bits.data, int.from_bytes
    while done < size and left:
        left -= 1
        word = number(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        found = table[word & mask]
        n, used = found >> 4, found & 15
        if n < 16:
            at += used
            if n:
                symbols.append(done)
                lengths.append(n)
                last = n
            done += 1
            continue
        word >>= used
        if n == 16:
            times = 3 + (word & 3)
            at += used + 2
            symbols += range(done, done + times)
            lengths += [last] * times
        elif n == 17:
            times = 3 + (word & 7)
            at += used + 3
        else:
            times = 11 + (word & 127)
            at += used + 7
        done += times
        if done > size:
            raise WebPError("code lengths run over the alphabet")
    bits.at = at
    if at > 8 * len(data):
        raise WebPError("the stream ends early")
    return symbols, lengths


@lru_cache(64)
def _token_code(lengths: tuple[int, ...]) -> _Code:
    used = [s for s, n in enumerate(lengths) if n]
    return _Code(used, [lengths[s] for s in used])


def _read_code(bits: _Bits, size: int) -> _Code:
    return _Code(*read_lengths(bits, size))


def _extended(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _ceil(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    groups_of, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_of = (_image(bits, _ceil(width, group_bits), _ceil(height, group_bits), False) >> 8) & 0xFFFF
    alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in alphabets] for _ in range(1 if groups_of is None else int(groups_of.max()) + 1)]
    cache, cache_shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    tables = [[x for code in group for x in (code.table, (1 << code.bits) - 1)] for group in groups]
    out, n = array("I"), 0
    total = width * height
    green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, _, _ = tables[0]
    distance = groups[0][4]
    data, at, end, number = bits.data, bits.at, 8 * len(bits.data), int.from_bytes
    while n < total:
        if groups_of is not None:
            y, x = divmod(n, width)
            group = int(groups_of[y >> group_bits, x >> group_bits])
            green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, _, _ = tables[group]
            distance = groups[group][4]
        word = number(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        g = green[word & green_mask]
        used = g & 15
        if g < 4096:
            word >>= used
            r = red[word & red_mask]
            word >>= r & 15
            b = blue[word & blue_mask]
            a = alpha[word >> (b & 15) & alpha_mask]
            at += used + (r & 15) + (b & 15) + (a & 15)
            out.append(a >> 4 << 24 | r >> 4 << 16 | g >> 4 << 8 | b >> 4)
            n += 1
        elif g < 4480:
            bits.at = at + used
            length = _extended(bits, (g >> 4) - 256)
            back = _extended(bits, distance.next(bits))
            at = bits.at
            if back > 120:
                back -= 120
            else:
                dx, dy = _NEAR[back - 1]
                back = max(dx + dy * width, 1)
            if back > n or n + length > total:
                raise WebPError("a back-reference leaves the image")
            out.extend((out[n - back : n] * -(-length // back))[:length] if back < length else out[n - back : n - back + length])
            n += length
        else:
            s = (g >> 4) - 280
            if s >= len(cache) or not cache_bits:
                raise WebPError("a colour lies outside the cache")
            for argb in out[cached:]:
                cache[(CACHE_HASH * argb & 0xFFFFFFFF) >> cache_shift] = argb
            cached = n
            at += used
            out.append(cache[s])
            n += 1
        if at > end:
            raise WebPError("the stream ends early")
    bits.at = at
    return np.frombuffer(out, np.uint32).reshape(height, width)


def _split(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as samples A, R, G, B of the last axis."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def _predicted(mode: int, left, top, top_left, top_right):
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(max(v, 0), 255)
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode < 10:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    half = mean(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(half, top_left, strict=True)]


def unpredict(argb: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = argb.shape
    kinds = (modes >> 8) & 15
    only = int(kinds.flat[0]) if (kinds == kinds.flat[0]).all() else -1
    if only in (0, 1, 2, 14, 15):  # sums along rows or columns
        out = _split(argb).copy()
        out[:1, 0, 0] += 255
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        if only == 2:
            out = np.cumsum(out, axis=0, dtype=np.uint8)
        else:
            out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
            if only == 1:
                out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
            else:
                out[1:, 1:, 0] += 255
        return out.view(">u4")[..., 0].astype(np.uint32)
    flat, kinds = _split(argb).reshape(-1, 4).tolist(), kinds.tolist()
    for i, residue in enumerate(flat):
        y, x = divmod(i, width)
        if y == 0:
            guess = [255, 0, 0, 0] if x == 0 else flat[i - 1]
        elif x == 0:
            guess = flat[i - width]
        else:
            guess = _predicted(kinds[y >> size_bits][x >> size_bits], flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        flat[i] = [(p + q) & 255 for p, q in zip(residue, guess, strict=True)]
    return np.array(flat, np.uint8).reshape(height, width, 4).view(">u4")[..., 0].astype(np.uint32)


def _uncross(argb: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = argb.shape
    spread = elements[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    _, red_to_blue, green_to_blue, green_to_red = (x.view(np.int8).astype(np.int32) for x in np.moveaxis(np.ascontiguousarray(_split(spread)), -1, 0).copy())
    out = _split(argb).astype(np.int32)
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(out[..., 2])
    red = out[..., 1] + ((green_to_red * green) >> 5)
    blue = out[..., 3] + ((green_to_blue * green) >> 5) + ((red_to_blue * signed(red)) >> 5)
    out[..., 1], out[..., 3] = red, blue
    return (out & 255).astype(np.uint8).view(">u4")[..., 0].astype(np.uint32)


def _add_green(argb: np.ndarray) -> np.ndarray:
    out = _split(argb).copy()
    out[..., 1] += out[..., 2]
    out[..., 3] += out[..., 2]
    return out.view(">u4")[..., 0].astype(np.uint32)


def _unindex(argb: np.ndarray, table: np.ndarray, width_bits: int, width: int) -> np.ndarray:
    index = (argb >> 8) & 255
    if width_bits:
        per, step = 1 << width_bits, 8 >> width_bits
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * step)) & ((1 << step) - 1)
        index = index.reshape(len(argb), -1)[:, :width]
    colours = np.zeros(256, np.uint32)
    colours[: len(table)] = table
    return colours[index]


def opened(data: bytes) -> tuple[_Bits, int, int, list]:
    """A WebP file with a VP8L image up to its pixels: the stream, the width of the pixels in it, the
    height, and the transforms to undo, the last first."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    body = chunk(data, b"VP8L")
    if body is None:
        raise WebPError("no lossless image")
    if body[:1] != b"\x2f":
        raise WebPError("no VP8L signature")
    size = int.from_bytes(body[1:5], "little")
    width, height, version = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1, size >> 29
    if version:
        raise WebPError("an unknown version")
    bits = _Bits(body, 40)
    undo = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [x[0] for x in undo]:
            raise WebPError("a transform comes twice")
        if kind < 2:
            size_bits = bits.read(3) + 2
            part = _image(bits, _ceil(width, size_bits), _ceil(height, size_bits), False)
            undo.append((kind, part, size_bits, width))
        elif kind == 2:
            undo.append((kind, None, 0, width))
        else:
            n_colours = bits.read(8) + 1
            table = np.cumsum(_split(_image(bits, n_colours, 1, False))[0], axis=0, dtype=np.uint8).view(">u4")[..., 0].astype(np.uint32)
            width_bits = 3 if n_colours <= 2 else 2 if n_colours <= 4 else 1 if n_colours <= 16 else 0
            undo.append((kind, table, width_bits, width))
            width = _ceil(width, width_bits)
    return bits, width, height, undo[::-1]


def undone(argb: np.ndarray, undo: list) -> np.ndarray:
    """Pixels as samples R, G, B, A, after the transforms are undone."""
    for kind, part, number, width in undo:
        argb = unpredict(argb, part, number) if kind == 0 else _uncross(argb, part, number) if kind == 1 else _add_green(argb) if kind == 2 else _unindex(argb, part, number, width)
    return np.ascontiguousarray(_split(argb)[..., [1, 2, 3, 0]])


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a VP8L image."""
    bits, width, height, undo = opened(data)
    return undone(_image(bits, width, height, True), undo)


def chunk(data: bytes, name: bytes) -> bytes | None:
    """The body of a RIFF file's chunk."""
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == name:
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None
