import hashlib
import zlib

import numpy as np
import pytest
import webp_writer as wr

from millrace.llm import media, webp, webp_batch


def picture(h=23, w=37, seed=0, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
        return table[rng.integers(0, colours, (h, w))]
    smooth = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[..., None] + np.array([0, 40, 90, 200])
    return ((smooth + rng.integers(0, 6, (h, w, 4))) % 256).astype(np.uint8)


@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 6, "references": True}])
@pytest.mark.parametrize("colours", [None, 5])
def test_prefix_codes_references_and_cache(options, colours):
    p = picture(colours=colours)
    w = wr.Writer()
    w.put(0, 1)
    wr.write_image(w, wr.to_argb(p), **options)
    assert (webp.decode(wr.file_of(w, 37, 23)) == p).all()


def test_groups_of_codes():
    p = picture(20, 30, 3)
    w = wr.Writer()
    w.put(0, 1)
    wr.write_image(w, wr.to_argb(p), groups=(np.random.default_rng(1).integers(0, 3, (5, 8)), 2), references=True, cache_bits=3)
    assert (webp.decode(wr.file_of(w, 30, 20)) == p).all()


def test_predictor():
    p = picture(18, 29, 4)
    modes = np.arange(5 * 8).reshape(5, 8) % 14
    w = wr.Writer()
    for value, n in ((1, 1), (0, 2), (0, 3)):
        w.put(value, n)
    wr.write_image(w, modes.astype(np.uint32) << 8, main=False)
    w.put(0, 1)
    wr.write_image(w, wr.predicted(wr.to_argb(p), modes, 2))
    assert (webp.decode(wr.file_of(w, 29, 18)) == p).all()


def test_subtract_green_and_cross_colour():
    p = picture(10, 17, 5)
    rng = np.random.default_rng(6)
    elements = rng.integers(0, 1 << 24, (3, 5)).astype(np.uint32) | np.uint32(0xFF000000)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    argb = p[..., [3, 0, 1, 2]].astype(int)
    argb[..., 1] -= argb[..., 2]
    argb[..., 3] -= argb[..., 2]
    argb %= 256
    spread = elements[np.arange(10)[:, None] >> 2, np.arange(17)[None, :] >> 2].astype(int)
    red, green = signed(argb[..., 1]), signed(argb[..., 2])
    argb[..., 3] -= (signed(spread >> 8) * green >> 5) + (signed(spread >> 16) * red >> 5)
    argb[..., 1] -= signed(spread) * green >> 5
    residue = np.ascontiguousarray((argb % 256).astype(np.uint8)).view(">u4")[..., 0].astype(np.uint32)
    w = wr.Writer()
    for value, n in ((1, 1), (2, 2), (1, 1), (1, 2), (0, 3)):
        w.put(value, n)
    wr.write_image(w, elements, main=False)
    w.put(0, 1)
    wr.write_image(w, residue)
    assert (webp.decode(wr.file_of(w, 17, 10)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 16, 17, 200])
def test_palette(colours):
    p = picture(9, 21, 7, colours)
    argb = wr.to_argb(p)
    table, index = np.unique(argb, return_inverse=True)
    index = index.reshape(argb.shape)
    bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    per = 1 << bits
    wide = -(-21 // per)
    padded = np.zeros((9, wide * per), np.uint32)
    padded[:, :21] = index
    packed = (padded.reshape(9, wide, per) << (np.arange(per, dtype=np.uint32) * (8 >> bits))).sum(axis=2, dtype=np.uint32) << 8
    delta = webp._split(table[None, :].astype(np.uint32))
    delta = np.diff(np.concatenate((np.zeros((1, 1, 4), np.uint8), delta), axis=1), axis=1).view(np.uint8)
    w = wr.Writer()
    for value, n in ((1, 1), (3, 2), (len(table) - 1, 8)):
        w.put(value, n)
    wr.write_image(w, np.ascontiguousarray(delta).view(">u4")[..., 0].astype(np.uint32), main=False)
    w.put(0, 1)
    wr.write_image(w, packed, references=True)
    assert (webp.decode(wr.file_of(w, 21, 9)) == p).all()


PAYLOADS = {
    "one byte": bytes(64),
    "all bytes": bytes(range(256)) * 40,
    "random": np.random.default_rng(3).integers(0, 256, 30_016, dtype=np.uint8).tobytes(),
    "runs": b"ab" * 3200 + b"c" * 6400,
    "rows that count": bytes((np.arange(12800) // 64 % 256).astype(np.uint8)),
    "rows that start anywhere": bytes((np.arange(12800) % 64 + np.repeat(np.random.default_rng(4).integers(0, 192, 200), 64)).astype(np.uint8)),
    "many pieces": b"the same words over and over again, " * 16 * 400,
}


def green(pixels):
    return b"".join(p[..., 1].tobytes() for p in pixels)


@pytest.mark.parametrize("name", PAYLOADS)
def test_payloads(name):
    """Written side by side, read in lanes and one by one."""
    payload = PAYLOADS[name]
    files = webp_batch.split(webp_batch.write([payload])[0])
    assert green(webp_batch.read(files)) == payload
    for a, b in zip(webp_batch.read(files), map(webp.decode, files), strict=True):
        assert a.shape == b.shape and (a == b).all()


@pytest.mark.parametrize("seed", range(8))
def test_groups_of_payloads(seed):
    rng = np.random.default_rng(seed)
    payloads = []
    for _ in range(60):
        letters, n = int(rng.integers(1, 257)), 64 * int(rng.integers(1, 200))
        p = rng.choice(256, letters, replace=False).astype(np.uint8)[np.minimum(rng.geometric(float(rng.uniform(0.02, 0.9)), n) - 1, letters - 1)]
        if rng.random() < 0.5:
            p = np.tile(p[: int(rng.integers(1, n + 1))], n)[:n]
        payloads.append(p.tobytes())
    media = webp_batch.write(payloads)
    files = [webp_batch.split(x) for x in media]
    found = list(webp_batch.read(f for x in files for f in x))
    assert green(found) == b"".join(payloads)
    assert all((a == webp.decode(f)).all() for a, f in zip(found, (f for x in files for f in x), strict=True))
    assert [webp_batch.write([p])[0] for p in payloads[:5]] == media[:5]  # a file does not depend on its group


def prose(n=900, seed=3):
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 123, k, dtype=np.uint8)) for k in rng.integers(3, 9, 200)]
    return media.padded(b" ".join(words[i] for i in rng.integers(0, 200, n)))


def test_payloads_are_stored_by_the_whole_method(monkeypatch):
    """Every stored piece of prose has a palette, codes, references and cached colours, all are read in
    lanes, and the files are smaller than what they hold."""
    payloads = [prose(n, n) for n in (200, 900, 3000)]
    files = [f for x in webp_batch.write(payloads) for f in webp_batch.split(x)]
    opened = [webp_batch._Opened(f) for f in files]
    lane, symbol, _, distance = webp_batch._symbols(opened)
    for i, x in enumerate(opened):
        mine = symbol[lane == i]
        assert [u[0] for u in x.undo] == [3] and len(x.green[0]) > 20 and len(x.cache)
        assert (mine < 256).any() and ((mine >= 256) & (mine < 280)).any() and (mine >= 280).any() and (distance[lane == i] > 0).any()
    seen = []
    monkeypatch.setattr(webp_batch, "_read_lanes", lambda x, f=webp_batch._read_lanes: (seen.extend(x), f(x))[1])
    monkeypatch.setattr(webp_batch, "decode", None)
    assert green(webp_batch.read(files)) == b"".join(payloads) and len(seen) == len(files)
    assert all(len(x) < 0.8 * len(p) for x, p in zip(webp_batch.write(payloads), payloads, strict=True))


def test_predictors_are_written_where_they_pay():
    for name, mode in (("rows that count", 2), ("rows that start anywhere", 1)):
        for f in webp_batch.split(webp_batch.write([PAYLOADS[name]])[0]):
            (kind, modes, _, _), palette = webp.opened(f)[3]
            assert kind == 0 and palette[0] == 3 and (modes >> 8 & 255 == mode).all()
            assert len(f) < 1000


def test_files_of_other_shapes_go_one_by_one():
    p = picture(9, 64, 7, 200)
    w = wr.Writer()
    w.put(0, 1)
    wr.write_image(w, wr.to_argb(p), references=True, cache_bits=4)
    other, mine = wr.file_of(w, 64, 9), webp_batch.write([prose()])[0]
    found = list(webp_batch.read([other, mine, other]))
    assert (found[0] == p).all() and (found[2] == p).all() and green(found[1:2]) == prose()


@pytest.mark.parametrize("mode", [0, 1, 2, 11])
def test_one_predictor_for_all_pixels(mode):
    p = picture(18, 29, 4)
    modes = np.full((5, 8), mode)
    w = wr.Writer()
    for value, n in ((1, 1), (0, 2), (0, 3)):
        w.put(value, n)
    wr.write_image(w, modes.astype(np.uint32) << 8, main=False)
    w.put(0, 1)
    wr.write_image(w, wr.predicted(wr.to_argb(p), modes, 2))
    assert (webp.decode(wr.file_of(w, 29, 18)) == p).all()


def plain_file(p):
    w = wr.Writer()
    w.put(0, 1)
    wr.write_image(w, wr.to_argb(p))
    return wr.file_of(w, p.shape[1], p.shape[0])


def test_damaged_files():
    data = plain_file(picture())
    for bad in (b"", data[:30], b"RIFX" + data[4:], data[:20] + b"\x00" + data[21:], data[:-40]):
        with pytest.raises((webp.WebPError, IndexError)):
            webp.decode(bad)
    whole, rng = webp_batch.write([prose()])[0], np.random.default_rng(5)
    for _ in range(200):  # damaged bits give other pixels or an error, and the same in lanes as alone
        bad = bytearray(whole)
        bad[int(rng.integers(20, len(bad)))] ^= 1 << int(rng.integers(0, 8))
        try:
            want = webp.decode(bytes(bad))
        except (webp.WebPError, IndexError):
            with pytest.raises((webp.WebPError, IndexError)):
                list(webp_batch.read([bytes(bad), whole]))
        else:
            assert (next(iter(webp_batch.read([bytes(bad), whole]))) == want).all()


def test_texts(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (5, "héllo"), (6, "long " * 300000), (None, "\0\0")]
    df = spark.createDataFrame([(t, i, "m") for i, t in rows], "text string, doc_id long, media string")
    got = {r.doc_id: r for r in media.describe(media.store_texts(df)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1][2:] == got[5][2:] and got[2][1:] == got[3][1:]
    assert media.describe(media.store_texts(df.limit(0))).collect() == []


def test_described_by_another_way(spark):
    """feature and media_sha256 against the pixels of the single-file decoder."""
    texts = ["", "a b c " * 40, prose(2500).decode("latin-1"), "é" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in media.store_texts(df).collect()}
    for r in media.describe(media.store_texts(df)).collect():
        pixels = np.concatenate([webp.decode(f) for f in webp_batch.split(stored[r.doc_id])])
        payload = media.padded(texts[r.doc_id].encode())
        assert pixels[..., 1].tobytes() == payload
        same = sum((a == b).all() for a, b in zip(pixels[1:].reshape(-1, 4), pixels[:-1].reshape(-1, 4), strict=True))
        sums = " ".join(str(int(pixels[..., k].astype(int).sum())) for k in range(4))
        assert r.feature == f"64x{len(payload) // 64} sums {sums} distinct {len(set(payload))} still {same}"
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def test_decoded_column(spark):
    p = picture()
    df = spark.createDataFrame([(bytearray(plain_file(p)), 1, "old"), (None, 2, "old"), (bytearray(b"junk"), 3, "old")], "file binary, id int, pixels string")
    got = {r.id: r.pixels for r in media.decode_column(df, "file").collect()}
    (one,) = got[1]
    assert (one.width, one.height, bytes(one.rgba)) == (37, 23, p.tobytes())
    assert got[2] is None and got[3][0].rgba is None and got[3][0].error
    other = media.decode_column(df, "file", "out").collect()  # a column called pixels stays
    assert {r.pixels for r in other} == {"old"} and sum(r.out is not None and r.out[0].rgba is not None for r in other) == 1
    assert media.decode_column(df.limit(0), "file").collect() == []


def test_all_files_of_a_column_are_decoded(spark):
    """A text above 8 KiB is several files, one after another; and whole files before a broken one come back."""
    text = "".join(chr(97 + (i * i) % 23) for i in range(40_500))
    stored = media.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    (row,) = media.decode_column(stored, "media").collect()
    samples = b"".join(bytes(p.rgba)[1::4] for p in row.pixels)
    assert len(row.pixels) == 5 and samples == media.padded(text.encode())
    two = bytearray(plain_file(picture()))
    df = spark.createDataFrame([(two + two + b"RIFF",)], "file binary")
    (row,) = media.decode_column(df, "file").collect()
    assert [p.error is None for p in row.pixels] == [True, True, False]
