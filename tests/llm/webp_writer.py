"""Writes VP8L images with every feature the decoder reads: the tests' own encoder."""

import struct

import numpy as np

from millrace.llm import webp


class Writer:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, code, n):
        self.bits += [code >> i & 1 for i in range(n - 1, -1, -1)]

    def data(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << i for i, b in enumerate(bits[at : at + 8])) for at in range(0, len(bits), 8))


def lengths_of(counts, limit):
    """Code lengths by Huffman's algorithm, with counts flattened until none is over the limit."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    weights = {s: counts[s] for s in used}
    while True:
        heap = sorted((n, i, [s]) for i, (s, n) in enumerate(weights.items()))
        out = [0] * len(counts)
        serial = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heap[:2]
            for s in x + y:
                out[s] += 1
            heap = sorted([*heap[2:], (a + b, serial, x + y)])
            serial += 1
        if max(out) <= limit:
            return out
        weights = {s: n // 2 + 1 for s, n in weights.items()}


def canonical(lengths):
    codes, code = {}, 0
    for n in range(1, max(lengths, default=0) + 1):
        for s, m in enumerate(lengths):
            if m == n:
                codes[s] = (code, n)
                code += 1
        code <<= 1
    return codes


def write_code(w, counts):
    used = [s for s, n in enumerate(counts) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        symbols = used or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(int(wide), 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return {symbols[0]: (0, 0)} if len(symbols) == 1 else {s: (i, 1) for i, s in enumerate(sorted(symbols))}
    lengths = lengths_of(counts, 15)
    tokens, i, last = [], 0, 8
    while i < len(lengths):
        n, run = lengths[i], 1
        while i + run < len(lengths) and lengths[i + run] == n:
            run += 1
        if n == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif n and n == last and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((n, 0, 0))
            last = n or last
        i += run
    counts2 = [0] * 19
    for t, _, _ in tokens:
        counts2[t] += 1
    lengths2 = lengths_of(counts2, 7)
    w.put(0, 1)
    w.put(15, 4)
    for s in webp._LENGTH_ORDER:
        w.put(lengths2[s], 3)
    w.put(0, 1)
    codes = canonical(lengths2) if sum(map(bool, lengths2)) > 1 else {s: (0, 0) for s, n in enumerate(lengths2) if n}
    for t, extra, n in tokens:
        w.code(*codes[t])
        w.put(extra, n)
    return canonical(lengths) if len(used) > 1 else {used[0]: (0, 0)}


def prefix(value):
    """Prefix code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def write_image(w, argb, *, main=True, cache_bits=0, references=False, groups=None):
    height, width = argb.shape
    flat = [int(x) for x in argb.reshape(-1)]
    near = {(dx + dy * width): n + 1 for n, (dx, dy) in reversed(list(enumerate(webp._NEAR))) if dx + dy * width >= 1}
    tokens, cache, at, seen = [], [None] * (1 << cache_bits), 0, {}
    key = lambda c: (0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        length, back = 0, 0
        if references:
            for candidate in (seen.get(tuple(flat[at : at + 3])), at - 1, at - width):
                if candidate is not None and candidate >= 0:
                    n = 0
                    while at + n < len(flat) and flat[candidate + n] == flat[at + n] and n < 4096:
                        n += 1
                    if n > length:
                        length, back = n, at - candidate
        start = at
        if length >= 3:
            tokens.append((at, "copy", length, near.get(back, back + 120)))
            at += length
        elif cache_bits and cache[key(flat[at])] == flat[at]:
            tokens.append((at, "cache", key(flat[at]), 0))
            at += 1
        else:
            tokens.append((at, "pixel", flat[at], 0))
            at += 1
        for i in range(start, at):
            if cache_bits:
                cache[key(flat[i])] = flat[i]
            if i >= 2:
                seen[tuple(flat[i - 2 : i + 1])] = i - 2
    w.put(int(bool(cache_bits)), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    group_of = lambda i: 0
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            table, bits = groups
            w.put(bits - 2, 3)
            write_image(w, (table.astype(np.uint32) << 8), main=False)
            group_of = lambda i: int(table[i // width >> bits, i % width >> bits])
    n_groups = int(groups[0].max()) + 1 if groups is not None else 1
    counts = [[[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40] for _ in range(n_groups)]

    def symbols(kind, a, b):
        if kind == "pixel":
            return [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + a, 0, 0)]
        (p, x, n), (q, y, m) = prefix(a), prefix(b)
        return [(0, 256 + p, x, n), (4, q, y, m)]

    for i, kind, a, b in tokens:
        for c, s, _, _ in symbols(kind, a, b):
            counts[group_of(i)][c][s] += 1
    codes = [[write_code(w, c) for c in group] for group in counts]
    for i, kind, a, b in tokens:
        for c, s, extra, n in symbols(kind, a, b):
            w.code(*codes[group_of(i)][c][s])
            w.put(extra, n)


def file_of(w, width, height):
    body = struct.pack("<BI", 0x2F, (width - 1) | (height - 1) << 14 | 1 << 28) + w.data()
    chunks = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WEBP" + chunks


def to_argb(pixels):
    p = pixels.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def predicted(argb, modes, bits):
    """Residues under the given modes, pixel by pixel."""
    split = webp._split(argb).astype(int)
    h, w = argb.shape
    flat = split.reshape(-1, 4)
    out = np.zeros_like(split)
    for y in range(h):
        for x in range(w):
            i = y * w + x
            if y == 0:
                guess = [255, 0, 0, 0] if x == 0 else flat[i - 1]
            elif x == 0:
                guess = flat[i - w]
            else:
                guess = webp._predicted(int(modes[y >> bits, x >> bits]), list(flat[i - 1]), list(flat[i - w]), list(flat[i - w - 1]), list(flat[i - w + 1]))
            out[y, x] = (split[y, x] - np.array(guess)) % 256
    return out.astype(np.uint8).view(">u4")[..., 0].astype(np.uint32)
