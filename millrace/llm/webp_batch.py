"""Bytes as lossless WebP images, many at once.

A payload is cut into pieces of up to PIECE bytes, each an image of WIDTH pixels a row whose green
samples are the bytes (red and blue 0, alpha 255); a payload's files stand one after another. An image
is written with a palette, with a predictor where that lowers its entropy, with a colour cache,
back-references and prefix codes of its own.

write() makes the files of a group of pieces side by side: each step is one numpy operation over all
bytes or symbols of the group. read() decodes a group in lanes: every step reads one symbol of every
image, back-references are then followed for all pixels together, and transforms are undone. Files
of other shapes (groups of codes, bundled pixels, longer codes, other transforms) go one by one
through webp.decode, which gives the same pixels for all files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .webp import _BACKWARD, _LENGTH_ORDER, _NEAR, CACHE_HASH, WebPError, decode, opened, read_lengths, undone

WIDTH, PIECE = 64, 64 * 128
#: Bytes of payload that are written, and pixels that are read, together.
WRITE_BYTES, READ_PIXELS = 1 << 19, 3 << 20
#: Longest codes written (and read in lanes) for pixels and for distances; the shortest copy written;
#: how often a colour has to be coded for its own symbol in the cache.
_LONGEST, _LONGEST_FAR, _SHORTEST_COPY, _OFTEN = 11, 7, 5, 16
#: A code for code lengths (0 to 11) and runs of zeros (17, 18), the same in all files.
_TOKEN_LENGTHS = {0: 3, 6: 3, 7: 3, 8: 3, 2: 4, 5: 4, 9: 4, 10: 4, 11: 4, 17: 4, 1: 5, 3: 5, 4: 5, 18: 5}
_CACHE_FROM = 280
_PAD = 512


def _token_codes() -> tuple[np.ndarray, np.ndarray]:
    codes, sizes, code, last = np.zeros(19, np.uint64), np.zeros(19, np.int64), 0, 0
    for n, t in sorted((n, t) for t, n in _TOKEN_LENGTHS.items()):
        code <<= n - last
        last = n
        codes[t], sizes[t] = _BACKWARD[code] >> (15 - n), n
        code += 1
    return codes, sizes


_TOKEN_CODE, _TOKEN_SIZE = _token_codes()
_BACK = np.array(_BACKWARD, np.uint64)
_MASK = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)
#: Extra bits and least value of each prefix of a length or distance.
_EXTRA = np.array([0, 0, 0, 0, *[(p - 2) >> 1 for p in range(4, 40)]], np.int64)
_BASE = np.array([1, 2, 3, 4, *[((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, 40)]], np.int64)
#: Distances of the codes 1 to 120 in rows of WIDTH pixels, and the codes of those distances.
_FROM_CODE = np.array([0, *[max(dx + dy * WIDTH, 1) for dx, dy in _NEAR]], np.int64)
_TO_CODE = np.zeros(_FROM_CODE.max() + 1, np.int64)
_TO_CODE[_FROM_CODE[:0:-1]] = np.arange(120, 0, -1)
_HASHES = ((np.array([[0], [0xFF000000]], np.uint64) | np.arange(256, dtype=np.uint64) << np.uint64(8)) * np.uint64(CACHE_HASH)) & np.uint64(0xFFFFFFFF)


@lru_cache(None)
def _cache_bits(opaque: int, colours: int) -> int:
    """The least bits of a colour cache in which no two of the colours meet."""
    return next(b for b in range(1, 12) if len(np.unique(_HASHES[opaque, :colours] >> np.uint64(32 - b))) == colours)


@lru_cache(256)
def _colours_of(opaque: int, bits: int, colours: int) -> np.ndarray | None:
    """The colour of each place of the cache, -1 if it has none; None if two colours meet."""
    places = (_HASHES[opaque, :colours] >> np.uint64(32 - bits)).astype(np.int64)
    out = np.full(1 << bits, -1, np.int64)
    out[places] = np.arange(colours)
    return out if (out[places] == np.arange(colours)).all() else None


def _log2(x: np.ndarray) -> np.ndarray:
    return np.frexp(x)[1].astype(np.int64) - 1


def _prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distances."""
    y = x - 1
    high = np.maximum(_log2(np.maximum(y, 1)), 1)
    code = np.where(y < 4, y, 2 * high + (y >> (high - 1) & 1))
    extra = np.where(y < 4, 0, high - 1)
    return code, y & ((1 << extra) - 1), extra


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=sizes.dtype) - sizes


def _lengths(image: np.ndarray, counts: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Lengths of complete prefix codes for entries (image, count), in order of image: each entry gets a
    share of the code space by its count, at least one place, and what rounding leaves is given out."""
    full = 1 << longest
    used, total = np.bincount(image, minlength=n), np.bincount(image, counts, minlength=n).astype(np.int64)
    share = 1 + counts * (full - used[image]) // total[image]
    weight = 1 << _log2(share)
    left = full - np.bincount(image, weight, minlength=n).astype(np.int64)
    for turn in range(64):
        open_ = np.flatnonzero(left[image] > 0)
        if not len(open_):
            break
        # The entries that lost most first; then the longest codes first, of which one always fits.
        order = open_[np.lexsort((weight[open_] / share[open_] if turn < 2 else weight[open_], image[open_]))]
        sizes = np.cumsum(weight[order])
        first = np.concatenate(([True], image[order][1:] != image[order][:-1]))
        before = np.maximum.accumulate(np.where(first, sizes - weight[order], 0))
        take = order[sizes - before <= left[image[order]]]
        left -= np.bincount(image[take], weight[take], minlength=n).astype(np.int64)
        weight[take] *= 2
    return longest - _log2(weight)


def _codes(image: np.ndarray, symbol: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """The codes of entries in order of (image, symbol), their first bit the least significant."""
    order = np.lexsort((symbol, size, image))
    places = np.cumsum(1 << (longest - size[order])) - (1 << (longest - size[order]))
    code = np.empty(len(order), np.int64)
    code[order] = (places & ((1 << longest) - 1)) >> (longest - size[order])  # images take the whole space each
    return _BACK[code] >> (15 - size).astype(np.uint64)


class _Code:
    """Prefix codes of one kind, one for each image, from its symbols."""

    def __init__(self, image: np.ndarray, symbol: np.ndarray, n: int, alphabet: np.ndarray, longest: int):
        top = int(alphabet.max())
        counts = np.bincount(image * top + symbol, minlength=n * top)
        found = np.flatnonzero(counts)
        self.n, self.alphabet = n, alphabet
        self.image, self.symbol = found // top, found % top
        self.used = np.bincount(self.image, minlength=n)
        size = _lengths(self.image, counts[found], n, longest)
        alone = self.used[self.image] == 1
        codes = _codes(self.image, self.symbol, size, longest)
        self.shown = np.where(alone, 1, size)
        place = np.zeros(n * top, np.int64)
        place[found] = np.arange(len(found))
        at = place[image * top + symbol]
        self.value, self.size = np.where(alone, np.uint64(0), codes)[at], np.where(alone, 0, size)[at]

    def header(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(image, value, size) of what tells the code: code lengths, in runs of zeros; an image
        without a symbol gets a code of the symbol 0."""
        ends = np.cumsum(self.used)
        none, some = np.flatnonzero(self.used == 0), np.flatnonzero(self.used)
        before = np.concatenate(([-1], self.symbol[:-1]))
        before[(ends - self.used)[some]] = -1
        gap = np.concatenate((self.symbol - before - 1, self.alphabet[some] - self.symbol[ends[some] - 1] - 1))
        shown = np.concatenate((self.shown, np.full(len(some), -1)))
        image = np.concatenate((self.image, some))
        order = np.argsort(image, kind="stable")
        gap, shown, image = gap[order], shown[order], image[order]
        runs, rest = gap // 138, gap % 138
        # What is left of the zeros, and the length itself, are written as one number.
        z, zn = _TOKEN_CODE[0], _TOKEN_SIZE[0]
        value = np.select([rest == 0, rest == 1, rest == 2, rest <= 10], [np.uint64(0), z, z | z << np.uint64(zn), _TOKEN_CODE[17] | (np.maximum(rest, 3) - 3).astype(np.uint64) << np.uint64(_TOKEN_SIZE[17])], _TOKEN_CODE[18] | (np.maximum(rest, 11) - 11).astype(np.uint64) << np.uint64(_TOKEN_SIZE[18]))
        size = np.select([rest == 0, rest == 1, rest == 2, rest <= 10], [0, zn, 2 * zn, _TOKEN_SIZE[17] + 3], _TOKEN_SIZE[18] + 7)
        value |= np.where(shown >= 0, _TOKEN_CODE[shown], np.uint64(0)) << size.astype(np.uint64)
        size = size + np.where(shown >= 0, _TOKEN_SIZE[shown], 0)
        times = runs + 1
        last = np.cumsum(times) - 1
        values = np.full(int(times.sum()), _TOKEN_CODE[18] | np.uint64(127) << np.uint64(_TOKEN_SIZE[18]))
        sizes = np.full(len(values), _TOKEN_SIZE[18] + 7)
        values[last], sizes[last] = value, size
        head, head_size = _code_head()
        images = np.concatenate((some, np.repeat(image, times), none))
        values = np.concatenate((np.full(len(some), head), values, np.full(len(none), np.uint64(1))))
        sizes = np.concatenate((np.full(len(some), head_size), sizes, np.full(len(none), 4)))
        order = np.argsort(images, kind="stable")
        return images[order], values[order], sizes[order]


@lru_cache(1)
def _code_head() -> tuple[np.uint64, int]:
    """A code by its lengths: the lengths of the code for those, in the format's order."""
    count = max(i for i, t in enumerate(_LENGTH_ORDER) if t in _TOKEN_LENGTHS) + 1
    value, size = (count - 4) << 1, 5
    for t in _LENGTH_ORDER[:count]:
        value |= _TOKEN_LENGTHS.get(t, 0) << size
        size += 3
    return np.uint64(value), size + 1


def _entropy(image: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(image * 256 + value, minlength=n * 256).reshape(n, 256).astype(np.float64)
    return (counts.sum(1) * np.log2(np.maximum(counts.sum(1), 1))) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _predicted(index: np.ndarray, image: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mode of each image's predictor (-1 none, 1 left, 2 top), where it lowers the entropy of the
    samples by a twentieth at least, and the samples with what is predicted taken off."""
    place = np.arange(len(index)) - starts[image]
    left, top = (np.concatenate((index[:k], index[k:] - index[: max(len(index) - k, 0)])) for k in (1, WIDTH))
    left = np.where(place == 0, index, np.where((place % WIDTH == 0), top, left))
    top = np.where(place < WIDTH, left, top)
    plain, by_left, by_top = (_entropy(image, x, n) for x in (index, left, top))
    best = np.minimum(by_left, by_top)
    mode = np.where(best < 0.95 * plain, np.where(by_left <= by_top, 1, 2), -1)
    of = mode[image]
    return mode, np.where(of == 1, left, np.where(of == 2, top, index))


def _copies(value: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) at each place: the run from there that stands as far before it in the same
    image, with the last place of the same four samples; length 1 where there is none."""
    n = len(value)
    four = np.ndarray((n,), "<u4", np.concatenate((value, np.zeros(3, np.uint8))), strides=(1,)).astype(np.uint64)
    key = (four ^ image.astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)
    key = np.sort(key[np.arange(n) + 4 <= ends[image]])
    place = (key & np.uint64(0xFFFFF)).astype(np.int64)
    at, before = place[1:], place[:-1]
    same = (key[1:] >> np.uint64(20) == key[:-1] >> np.uint64(20)) & (four[at] == four[before]) & (image[at] == image[before])
    back = np.zeros(n, np.int64)
    back[at[same]] = (at - before)[same]
    cuts = np.concatenate((np.flatnonzero(back[1:] != back[:-1]) + 1, [n]))
    run_end = np.repeat(cuts, np.diff(cuts, prepend=0))
    length = np.where(back > 0, np.minimum(run_end - np.arange(n) + 3, 4096), 1)
    return np.where(length >= _SHORTEST_COPY, length, 1), back


def _chosen(length: np.ndarray) -> np.ndarray:
    """The places at which symbols are written, from left to right: a copy is taken where one begins."""
    begins = np.flatnonzero(length > 1)
    after = np.searchsorted(begins, begins + length[begins]).tolist()
    taken, k, n = [], 0, len(after)
    while k < n:
        taken.append(k)
        k = after[k]
    begins = begins[taken]
    inside = np.zeros(len(length) + 1, np.int8)
    inside[begins + 1] = 1
    inside[begins + length[begins]] -= 1
    return np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)


def _write_group(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    n, ends, starts = len(sizes), np.cumsum(sizes), _starts(sizes)
    image = np.repeat(np.arange(n), sizes)
    flat = image * 256 + data
    present = np.bincount(flat, minlength=n * 256).reshape(n, 256) > 0
    colours = np.maximum(present.sum(1), 17)  # with fewer, several pixels would share a sample
    index = (np.cumsum(present, axis=1).reshape(-1)[flat] - 1).astype(np.uint8)
    mode, value = _predicted(index, image, starts, n)
    opaque = (mode < 0).astype(np.int64)  # a predicted alpha leaves nothing
    range_ = np.where(mode < 0, colours, 256)
    bits = np.array([_cache_bits(o, c) for o, c in zip(opaque.tolist(), range_.tolist(), strict=True)])

    length, back = _copies(value, image, ends)
    place = _chosen(length)
    length, back, of = length[place], back[place], image[place]
    copy = length > 1
    key = image * 256 + value
    first = np.empty(n * 256, np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    mine = key[place]
    often = np.bincount(mine[~copy], minlength=n * 256) >= _OFTEN
    cached = ~copy & often[mine] & (first[mine] < place)
    hashed = (_HASHES[opaque[of], value[place]] >> (32 - bits[of]).astype(np.uint64)).astype(np.int64)
    of_length, length_extra, length_bits = _prefix(length)
    symbol = np.where(copy, 256 + of_length, np.where(cached, _CACHE_FROM + hashed, value[place]))
    far = np.flatnonzero(copy)
    distance = back[far]
    near = _TO_CODE[np.minimum(distance, len(_TO_CODE) - 1)] * (distance < len(_TO_CODE))
    of_far, far_extra, far_bits = _prefix(np.where(near > 0, near, distance + 120))
    pixels = _Code(of, symbol, n, _CACHE_FROM + (1 << bits), _LONGEST)
    distances = _Code(of[far], of_far, n, np.full(n, 40), _LONGEST_FAR)
    word, size = pixels.value.copy(), pixels.size.copy()
    for put, more in ((length_extra[far], length_bits[far]), (distances.value, distances.size), (far_extra, far_bits)):
        word[far] |= put.astype(np.uint64) << size[far].astype(np.uint64)
        size[far] += more

    table = np.full((n, 256), -1)
    table[present] = np.nonzero(present)[1]
    table = np.sort(np.where(table < 0, 999, table), axis=1)
    shown = np.arange(256) < colours[:, None]
    table = np.minimum(table, np.max(np.where(table < 999, table, 0), axis=1, keepdims=True))
    delta = np.diff(table, axis=1, prepend=0)[shown]
    of_colour = np.repeat(np.arange(n), colours)
    palette = _Code(of_colour, delta, n, np.full(n, _CACHE_FROM), _LONGEST)
    alpha = np.concatenate(([1], (of_colour[1:] != of_colour[:-1]).astype(np.int64))).astype(np.uint64)  # 255 once, then 0

    each = np.arange(n)
    one = lambda v, size: (each, np.broadcast_to(np.asarray(v, np.uint64), n), np.broadcast_to(np.asarray(size, np.int64), n))
    zero, zeros = 0b0001, 4  # a code of the one symbol 0
    alone = lambda s: (0b101 | s << 3, 11)  # a code of the one symbol s
    predicted = mode >= 0
    predictor = np.where(predicted, 0b001 | 7 << 3 | alone(0)[0] << 7 | mode.clip(0) << 10 | zero << 18 | zero << 22 | zero << 26 | zero << 30, 0)
    parts = [
        one(0x2F, 8), one((WIDTH - 1) | (sizes // WIDTH - 1) << 14 | 1 << 28, 32),
        one(0b111 | (colours - 1) << 3, 12),  # a palette, its size, no cache in it
        palette.header(), one(zero | zero << 4 | (0b111 | 255 << 11) << 8 | zero << 27, 31),
        (of_colour, palette.value | alpha << palette.size.astype(np.uint64), palette.size + 1),
        (each, predictor.astype(np.uint64), np.where(predicted, 34, 0)),
        one(0b10 | bits << 2, 7),  # no more transforms, a cache, one group of codes
        pixels.header(), one(zero | zero << 4, 8), one(np.where(opaque, alone(255)[0], alone(0)[0]), 11), distances.header(),
        (of, word, size),
    ]
    return _files(parts, n)


def _files(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[bytes]:
    """A file for each image from numbers of so many bits each, part after part, each in order of image."""
    per = np.array([np.bincount(image, size, minlength=n) for image, _, size in parts]).astype(np.int64)
    total = per.sum(0)
    starts = _starts((total + 63) // 64) * 64
    begin = starts + np.cumsum(per, axis=0) - per
    words = np.zeros(int(((total + 63) // 64).sum()) + 1, np.uint64)
    for k, (image, value, size) in enumerate(parts):
        bit = _starts(size) - _starts(per[k])[image] + begin[k][image]
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, value << shift)
        over = np.flatnonzero((bit & 63) + size > 64)
        np.bitwise_or.at(words, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
    raw, out = words.tobytes(), []
    for at, size in zip((starts // 8).tolist(), ((total + 7) // 8).tolist(), strict=True):
        out.append(b"RIFF" + struct.pack("<I", size + (size & 1) + 12) + b"WEBPVP8L" + struct.pack("<I", size) + raw[at : at + size] + b"\0" * (size & 1))
    return out


def write(payloads: list[bytes]) -> list[bytes]:
    """For each payload, of a positive multiple of 64 bytes, the files that hold it, one after another."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held, owners, size = [], [], 0

    def flush() -> None:
        for owner, file in zip(owners, _write_group(np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])), strict=True):
            out[owner].append(file)

    for i, payload in enumerate(payloads):
        for at in range(0, len(payload), PIECE):
            held.append(payload[at : at + PIECE])
            owners.append(i)
            size += len(held[-1])
            if size >= WRITE_BYTES:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return [b"".join(x) for x in out]


def files(data: bytes) -> Iterator[bytes]:
    """The files that stand one after another in data."""
    at = 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] != b"RIFF" or size < 20 or at + size > len(data):
            raise WebPError("not a WebP file")
        yield data[at : at + size]
        at += size


def split(data: bytes) -> list[bytes]:
    return list(files(data))


class _Opened:
    """A file as far as the lanes need it, or an error if its shape is another."""

    def __init__(self, file: bytes):
        bits, width, self.height, self.undo = opened(file)
        self.pixels = width * self.height
        kinds = [x[0] for x in self.undo]
        if width != WIDTH or kinds not in ([3], [0, 3]) or self.undo[-1][2] or self.pixels > PIECE:
            raise WebPError("of another shape")
        cache_bits = bits.read(4) if bits.read(1) else 0
        if bits.read(1) or cache_bits > 10:
            raise WebPError("of another shape")
        self.green = read_lengths(bits, _CACHE_FROM + (1 << cache_bits if cache_bits else 0))
        (red, _), (blue, _), (alpha, _), self.far = (read_lengths(bits, size) for size in (256, 256, 256, 40))
        if red != [0] or blue != [0] or alpha not in ([0], [255]) or max(self.green[1]) > _LONGEST or max(self.far[1]) > _LONGEST_FAR or not self.green[0]:
            raise WebPError("of another shape")
        self.alpha = alpha[0]
        self.colours = len(self.undo[-1][1]) if kinds == [3] else 256
        self.cache = _colours_of(int(self.alpha == 255), cache_bits, self.colours) if cache_bits else np.zeros(0, np.int64)
        if self.cache is None:
            raise WebPError("of another shape")
        self.data, self.at = bits.data, bits.at


def _tables(codes: list[tuple[list[int], list[int]]], longest: int) -> np.ndarray:
    """For each code a table over `longest` bits of 16 * symbol + length, one table after another."""
    count = np.array([len(s) for s, _ in codes])
    image = np.repeat(np.arange(len(codes)), count)
    symbol, size = (np.concatenate([np.array(x[k], np.int64) for x in codes]) for k in (0, 1))
    size = np.where(count[image] == 1, 0, size)
    order = np.lexsort((symbol, size, image))
    times = 1 << (longest - size[order])
    if (np.bincount(image[order], times, minlength=len(codes)) != 1 << longest).any():
        raise WebPError("a prefix code is incomplete")
    forward = np.repeat((symbol << 4 | size)[order].astype(np.uint16), times).reshape(len(codes), -1)
    return forward[:, (_BACK[: 1 << longest] >> np.uint64(15 - longest)).astype(np.int64)].reshape(-1)


def _symbols(opened_: list[_Opened]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lane, symbol, length, distance) of all symbols of the images, image after image."""
    lengths = np.array([len(x.data) for x in opened_])
    buffer = np.frombuffer(b"".join(x.data for x in opened_) + bytes(_PAD), np.uint8)
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    tables, fars = _tables([x.green for x in opened_], _LONGEST), _tables([x.far for x in opened_], _LONGEST_FAR)
    lane = np.arange(len(opened_))
    at = _starts(lengths) * 8 + np.array([x.at for x in opened_])
    room = lengths * 8 - np.array([x.at for x in opened_])
    need = np.array([x.pixels for x in opened_])
    table, far_table = lane << _LONGEST, lane << _LONGEST_FAR
    mask, far_mask = np.uint64((1 << _LONGEST) - 1), np.uint64((1 << _LONGEST_FAR) - 1)
    blocks: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        rows: list[tuple[np.ndarray, ...]] = []
        for _ in range(32):
            word = words[at >> 3] >> (at & 7).astype(np.uint64)
            found = tables[table + (word & mask).astype(np.int64)].astype(np.int64)
            used, symbol = found & 15, found >> 4
            length, distance = np.ones(len(lane), np.uint16), np.zeros(len(lane), np.int32)
            copy = np.flatnonzero((symbol & -256 == 256) & (symbol < _CACHE_FROM))
            if len(copy):
                rest, prefix = word[copy] >> used[copy].astype(np.uint64), symbol[copy] - 256
                extra = _EXTRA[prefix]
                length[copy] = _BASE[prefix] + (rest & _MASK[extra]).astype(np.int64)
                rest >>= extra.astype(np.uint64)
                found = fars[far_table[copy] + (rest & far_mask).astype(np.int64)].astype(np.int64)
                size, prefix = found & 15, found >> 4
                more = _EXTRA[prefix]
                distance[copy] = _BASE[prefix] + (rest >> size.astype(np.uint64) & _MASK[more]).astype(np.int64)
                used[copy] += extra + size + more
            at = at + used
            need = need - length
            rows.append((symbol.astype(np.uint16), length, distance, used.astype(np.uint8)))
            if at[0] >> 3 >= len(words) - 8:
                break
            at = np.minimum(at, 8 * (len(words) - 8))
        blocks.append((np.tile(lane.astype(np.uint16), len(rows)), *(np.concatenate([r[k] for r in rows]) for k in range(4))))
        left = need > 0
        lane, at, need, table, far_table = lane[left], at[left], need[left], table[left], far_table[left]
    lane, symbol, length, distance, used = (np.concatenate([b[k] for b in blocks]) for k in range(5))
    order = np.argsort(lane, kind="stable")
    lane, symbol, length, distance = lane[order].astype(np.int32), symbol[order].astype(np.int32), length[order].astype(np.int32), distance[order]
    ends = np.cumsum(length, dtype=np.int32)
    first = np.searchsorted(lane, np.arange(len(opened_)))
    start = ends - length - (ends - length)[first][lane]
    total = np.array([x.pixels for x in opened_], np.int32)[lane]
    use = start < total
    if (start + length > total)[use].any():
        raise WebPError("a back-reference leaves the image")
    if (np.bincount(lane[use], used[order][use], minlength=len(opened_)) > room).any():
        raise WebPError("the stream ends early")
    return lane[use], symbol[use], length[use], distance[use]


def _read_lanes(opened_: list[_Opened]) -> list[np.ndarray]:
    lane, symbol, length, distance = _symbols(opened_)
    pixels = np.array([x.pixels for x in opened_], np.int32)
    colours = np.array([x.colours for x in opened_], np.int32)
    place = _starts(length)
    copy = distance > 0
    cached = symbol >= _CACHE_FROM
    cache_at = _starts(np.array([len(x.cache) for x in opened_]))
    value = np.where(copy, 0, symbol)
    caches = np.concatenate([x.cache for x in opened_])
    value[cached] = caches[cache_at[lane[cached]] + symbol[cached] - _CACHE_FROM]
    near = distance <= 120
    back = np.where(near, _FROM_CODE[np.where(near, distance, 0)], distance - 120)
    starts = _starts(pixels)
    back = back.astype(np.int32)
    if (value < 0).any() or (value >= colours[lane]).any() or (back > place - starts[lane])[copy].any():
        raise WebPError("a colour or a back-reference leaves the image")
    source = np.arange(int(pixels.sum()), dtype=np.int32)
    copied = np.flatnonzero(np.repeat(copy, length))
    source[copied] -= np.repeat(back[copy], length[copy])
    while len(copied):  # each round halves the copies between a pixel and what it was copied from
        near = source[copied]
        origin = source[near]
        source[copied] = origin
        copied = copied[origin != near]
    out = np.repeat(value.astype(np.uint8), length)[source]
    key = np.repeat(np.arange(len(opened_), dtype=np.int32) * 256, pixels) + out
    first = np.empty(len(opened_) * 256, np.int32)
    first[key[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
    if (first[lane * 256 + value] >= place)[cached].any():
        raise WebPError("a colour is not in the cache yet")
    found = []
    for x, a, b in zip(opened_, starts.tolist(), (starts + pixels).tolist(), strict=True):
        argb = (out[a:b].astype(np.uint32) << np.uint32(8) | np.uint32(x.alpha << 24)).reshape(x.height, WIDTH)
        found.append(undone(argb, x.undo))
    return found


def _read_group(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file. A group in which a file is damaged or of another shape goes one by one."""
    lanes, where, out = [], [], [None] * len(files)
    for i, file in enumerate(files):
        try:
            lanes.append(_Opened(file))
            where.append(i)
        except (WebPError, ValueError):
            out[i] = decode(file)
    if lanes:
        try:
            found = _read_lanes(lanes)
        except WebPError:
            found = [decode(files[i]) for i in where]
        for i, pixels in zip(where, found, strict=True):
            out[i] = pixels
    return out


def area(file: bytes) -> int:
    """How many pixels a file of write() has, by its header."""
    size = int.from_bytes(file[21:25], "little")
    return ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)


def read(files: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The pixels of each file, in order; files are decoded in groups of about READ_PIXELS pixels,
    fastest if those of a group are of about the same size."""
    held, size = [], 0
    for file in files:
        held.append(file)
        size += area(file)
        if size >= READ_PIXELS:
            yield from _read_group(held)
            held, size = [], 0
    if held:
        yield from _read_group(held)
