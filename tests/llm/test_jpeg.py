import random
from math import cos, pi, sqrt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jpeg


def padded(raw):
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=4000))
def test_payload_round_trip(raw):
    payload = padded(raw)
    file = jpeg.encode_payload(payload, len(raw))
    assert jpeg.decode_payload(jpeg.decode(file)) == (payload, len(raw))


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> n - 1 - i & 1 for i in range(n)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


ALL = (bytes([0] * 7 + [255] + [0] * 8), bytes(range(255)))  # every symbol below 255 by its own value, in 8 bits


def extra(v, size):
    return v if v > 0 else v + (1 << size) - 1


def general_file(coefs, h, v, width, height, restart=0):
    """A plain progressive encoder for sparse coefficients (component: rows x cols x 64, zigzag), one bit of approximation."""
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes(range(1, 65)))]
    out.append(jpeg._segment(0xC4, b"\x00" + ALL[0] + ALL[1] + b"\x10" + ALL[0] + ALL[1]))
    comps = b"".join(bytes([i + 1, (h << 4 | v) if i == 0 else 0x11, 0]) for i in range(len(coefs)))
    out.append(jpeg._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coefs)]) + comps))
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))

    def scan(parts, first, last, approx, units, code):
        head = bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([first, last, approx])
        body, step = b"", restart or len(units)
        for k, lo in enumerate(range(0, len(units), step)):
            w = Writer()
            code(w, units[lo : lo + step])
            body += (b"" if k == 0 else bytes([0xFF, 0xD0 + (k - 1) % 8])) + w.done()
        out.append(jpeg._segment(0xDA, head) + body)

    # DC of all components interleaved
    mcus = []
    rows, cols = coefs[-1].shape[:2] if len(coefs) > 1 else (coefs[0].shape[0] // v, coefs[0].shape[1] // h)
    for r in range(rows):
        for c in range(cols):
            mcu = [(0, r * v + y, c * h + x) for y in range(v) for x in range(h)] if len(coefs) > 1 else [(0, r, c)]
            mcus.append(mcu + [(i, r, c) for i in range(1, len(coefs))])

    def dc_first(w, units):
        pred = [0] * len(coefs)
        for mcu in units:
            for i, r, c in mcu:
                x = int(coefs[i][r, c, 0]) >> 1
                d, pred[i] = x - pred[i], x
                size = abs(d).bit_length()
                w.put(size, 8)
                w.put(extra(d, size) if d else 0, size)

    def dc_low(w, units):
        for mcu in units:
            for i, r, c in mcu:
                w.put(int(coefs[i][r, c, 0]) & 1, 1)

    scan(range(len(coefs)), 0, 0, 0x01, mcus, dc_first)
    for i, full in enumerate(coefs):
        hh, vv = (h, v) if i == 0 else (1, 1)
        if len(coefs) == 1:
            hh = vv = h = v = 1
        wide, high = -(-(-(-width * hh // h)) // 8), -(-(-(-height * vv // v)) // 8)
        blocks = [full[r, c] for r in range(high) for c in range(wide)]

        def ac_first(w, units):
            for b in units:
                run = 0
                last = max((k for k in range(1, 64) if abs(int(b[k])) >> 1), default=0)
                for k in range(1, last + 1):
                    m = abs(int(b[k])) >> 1
                    if not m:
                        run += 1
                        continue
                    while run > 15:
                        w.put(0xF0, 8)
                        run -= 16
                    size = m.bit_length()
                    w.put(run << 4 | size, 8)
                    w.put(extra(m if b[k] > 0 else -m, size), size)
                    run = 0
                if last < 63:
                    w.put(0, 8)

        def ac_low(w, units):
            for b in units:
                news = [k for k in range(1, 64) if abs(int(b[k])) == 1]
                last = max(news, default=0)
                run, held = 0, []
                for k in range(1, 64):
                    m = abs(int(b[k]))
                    if k > last:
                        break
                    if m > 1:
                        held.append(m & 1)
                    elif m == 1:
                        w.put(run << 4 | 1, 8)
                        w.put(int(b[k] > 0), 1)
                        for x in held:
                            w.put(x, 1)
                        run, held = 0, []
                    else:
                        if run == 15:
                            w.put(0xF0, 8)
                            for x in held:
                                w.put(x, 1)
                            run, held = 0, []
                        else:
                            run += 1
                if last < 63:
                    w.put(0, 8)
                    for k in range(last + 1, 64):
                        if abs(int(b[k])) > 1:
                            w.put(abs(int(b[k])) & 1, 1)

        scan([i], 1, 63, 0x01, blocks, ac_first)
        scan([i], 1, 63, 0x10, blocks, ac_low)
    scan(range(len(coefs)), 0, 0, 0x10, mcus, dc_low)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("width", "height", "h", "v", "n", "restart"), [(33, 20, 2, 2, 3, 0), (16, 16, 1, 1, 3, 0), (40, 9, 2, 1, 3, 2), (17, 30, 1, 1, 1, 3)])
def test_sparse_files(width, height, h, v, n, restart):
    dice = random.Random(width)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    coefs = []
    for i in range(n):
        shape = (down * v, across * h) if i == 0 else (down, across)
        c = np.zeros((*shape, 64), np.int64)
        for b in c.reshape(-1, 64):
            b[0] = dice.randint(-200, 200)
            for k in dice.sample(range(1, 64), dice.choice([0, 1, 3, 40])):
                b[k] = dice.choice([-9, -2, -1, 1, 1, 3, 60])
        coefs.append(c)
    image = jpeg.decode(general_file(coefs, h, v, width, height, restart))
    for c, want in zip(image.components, coefs, strict=True):
        assert (c.coefs[: c.high, : c.wide, 1:] == want[: c.high, : c.wide, 1:]).all()
        assert (c.coefs[..., 0] == want[..., 0]).all()
    assert jpeg.rgb(image).shape == (height, width, 3)


def test_inverse_transform():
    payload = padded(bytes(range(256)) * 3)
    image = jpeg.decode(jpeg.encode_payload(payload, 768))
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = image.components[0].coefs[0, 1]
    block = block.reshape(8, 8)
    c = [sqrt(0.5), *[1] * 7]
    want = [[128 + sum(c[u] * c[v] / 4 * block[v, u] * cos((2 * x + 1) * u * pi / 16) * cos((2 * y + 1) * v * pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    got = jpeg.planes(image)[0][:8, 8:16]
    assert np.abs(np.clip(want, 0, 255) - got).max() <= 0.51


def test_documents(docs, empty):
    import hashlib

    rows = jpeg.read_media(jpeg.to_media(docs.select("doc_id", "text")), payload=True).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert bytes(r["payload"]) == padded(raw) and r["n_bytes"] == len(raw)
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    by = {}
    for r in rows:
        by.setdefault(hashlib.md5(bytes(r["payload"])).hexdigest(), set()).add((bytes(r["media"]), r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert jpeg.read_media(jpeg.to_media(empty)).count() == 0


def test_null_media_and_bad_files(spark):
    df = spark.createDataFrame([(1, None)], "i int, media binary")
    assert jpeg.read_media(df).first()["rgb"] is None
    with pytest.raises(ValueError):
        jpeg.decode(b"GIF89a")


def test_slices_do_not_matter(monkeypatch):
    dice = random.Random(4)
    payloads = [bytes(dice.randrange(256) for _ in range(n)) for n in (1, 64, 600, 5000, 30_000)]
    files = [jpeg.encode_payload(p, len(p)) for p in payloads]
    whole = [(jpeg.rgb(jpeg.decode(f)).tobytes(), jpeg.decode_payload(jpeg.decode(f))) for f in files]
    monkeypatch.setattr(jpeg, "SLICE_BLOCKS", 8)
    for f, p, (pixels, payload) in zip(files, payloads, whole, strict=True):
        image = jpeg.decode(f)
        assert jpeg.rgb(image).tobytes() == pixels and jpeg.decode_payload(image) == payload == (p, len(p))


def test_existing_columns_are_replaced_and_the_tensor_is_stored(spark):
    df = spark.createDataFrame([(1, "some text", 7, "u"), (2, None, 8, "v")], "doc_id long, text string, MEDIA int, _text string")
    stored = jpeg.to_media(df)
    assert stored.columns == ["doc_id", "_text", "media"]
    read = jpeg.read_media(stored.withColumn("Height", stored["doc_id"]), payload=True)
    assert read.columns == ["doc_id", "_text", "media", "height", "width", "feature", "rgb", "n_bytes", "payload"]
    for r in read.collect():
        assert len(r["rgb"]) == 3 * r["height"] * r["width"] and r["payload"][: r["n_bytes"]] == (b"some text" if r["doc_id"] == 1 else b"")
