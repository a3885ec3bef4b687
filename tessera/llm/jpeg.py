"""Progressive JPEG media columns: a decoder in numpy, and a lossless carrier for byte payloads.

Memory: files are done one by one and in slices of SLICE_BLOCKS blocks, in batches of a few megabytes; the README has the
peak for a long text.

decode() accumulates all scans of a progressive file (DC and AC, first passes and refinements, spectral selection,
interleaved DC scans, restart intervals) into coefficient arrays. rgb() dequantizes, inverse-transforms, upsamples the
chroma and gives the full-resolution RGB tensor. Scans in which every symbol is the same are read by array
operations and checked; all others go through the bit reader.

encode_payload() stores bytes as quantized coefficients, the unit that JPEG keeps exactly: the DC coefficient of a block
holds byte - 128, and each AC coefficient is the value of size 8 (128 to 255, or -255 to -128) whose extra bits are
the byte. They are sent in 4:2:0 by seven scans a component group: DC >> 1, AC 1-5 >> 1, AC 6-63 >> 1, then the low
bits by refinement. Sizes stand in a comment; blocks beyond the payload hold bytes of 255.

All sums are exact (integer products in double precision), so that equal texts give equal values.

Defined results: null text is an empty one; a null media value gives null columns; a file that isn't a progressive
JPEG of one or three 8-bit components raises ValueError; repeated rows are done one by one; an empty table gives an
empty one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, cos, isqrt, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, release_memory, slices, widened, worker_cache

UNIT = 576
SLICE_BLOCKS = 1 << 14  # a multiple of 8, so that slices of a scan begin at whole bytes


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient: diagonals in turn, odd ones downwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 18  # products of 11-bit coefficients then stay below 2^53
_BASIS = np.rint(np.array([[(sqrt(1 / 8) if u == 0 else 0.5) * cos((2 * x + 1) * u * pi / 16) for u in range(8)] for x in range(8)]) * (1 << _SCALE))
_MARKER = re.compile(rb"\xff[\x01-\xfe]")


class Huffman:
    """Canonical codes from 16 counts and the symbols; look-ups by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        self.look = [(0, 0)] * 65536
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                s = symbols[at]
                self.codes[s] = (code, length)
                self.look[code << 16 - length : (code + 1) << 16 - length] = [(s, length)] * (1 << 16 - length)
                code, at = code + 1, at + 1
            code <<= 1


_huffmans: dict[tuple[bytes, bytes], Huffman] = {}


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    if (counts, symbols) not in _huffmans:
        if len(_huffmans) > 64:
            _huffmans.clear()
        _huffmans[counts, symbols] = Huffman(counts, symbols)
    return _huffmans[counts, symbols]


class Bits:
    """Reader over the bytes of one restart segment, stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def symbol(self, table: Huffman) -> int:
        byte = self.at >> 3
        s, n = table.look[int.from_bytes(self.data[byte : byte + 3], "big") >> 8 - (self.at & 7) & 0xFFFF]
        if not n:
            raise ValueError("undefined code")
        self.at += n
        return s

    def take(self, n: int) -> int:
        byte = self.at >> 3
        v = int.from_bytes(self.data[byte : byte + 4], "big") >> 32 - (self.at & 7) - n & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that scans of this component alone have
    high: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.empty(0))  # block rows, block columns, 64 in zigzag order


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)  # in zigzag order
    comments: list[bytes] = field(default_factory=list)


def decode(data: bytes) -> Image:
    """All coefficients of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                image.quant[n] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            _frame(image, body)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive JPEG file with Huffman codes")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            image.comments.append(body)
        elif kind == 0xDA:
            segments = []
            while True:
                found = _MARKER.search(data, at)
                if not found:
                    raise ValueError("the file ends inside a scan")
                segments.append(data[at : found.start()].replace(b"\xff\x00", b"\xff"))
                at = found.start()
                if not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
            _scan(image, body, tables, restart, segments)


def _frame(image: Image, body: bytes) -> None:
    depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or n not in (1, 3) or not image.height or not image.width:
        raise ValueError("one or three components of 8 bits are expected")
    image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    across, down = ceil(image.width / (8 * h)), ceil(image.height / (8 * v))
    for c in image.components:
        c.wide, c.high = ceil(ceil(image.width * c.h / h) / 8), ceil(ceil(image.height * c.v / v) / 8)
        c.coefs = np.zeros((down * c.v, across * c.h, 64), np.int16)


def _scan(image: Image, body: bytes, tables: dict[int, Huffman], restart: int, segments: list[bytes]) -> None:
    n = body[0]
    by_id = {c.ident: c for c in image.components}
    parts = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
    first, last, before, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1:
        c = parts[0][0]
        units = [(0, np.arange(c.high)[:, None] * c.coefs.shape[1] + np.arange(c.wide)[None, :])]
        order = [(0, units[0][1].ravel())]
        per = 1
    else:
        # an MCU has v x h blocks of each component in turn
        order = []
        for i, (c, _, _) in enumerate(parts):
            rows, cols = c.coefs.shape[:2]
            grid = (np.arange(rows)[:, None] * cols + np.arange(cols)).reshape(rows // c.v, c.v, cols // c.h, c.h)
            order.append((i, grid.transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)))
        per = sum(c.h * c.v for c, _, _ in parts)
    which = np.concatenate([np.full(o.shape[-1] if n > 1 else 1, i) for i, o in order]) if n > 1 else np.zeros(1, int)
    blocks = np.concatenate([o for _, o in order], axis=1) if n > 1 else order[0][1][:, None]
    step = restart or len(blocks)
    if len(segments) < ceil(len(blocks) / step):
        raise ValueError("restart segments are missing")
    for k, lo in enumerate(range(0, len(blocks), step)):
        part = blocks[lo : lo + step]
        if first == 0:
            _dc(parts, which, part, segments[k], tables, before, low)
        elif n == 1:
            coefs = parts[0][0].coefs.reshape(-1, 64)
            table = tables[0x10 | parts[0][2]]
            (_ac_refine if before else _ac_first)(coefs, part[:, 0], segments[k], table, first, last, low)
        else:
            raise ValueError("an AC scan has one component")


def _dc(parts: list, which: np.ndarray, blocks: np.ndarray, data: bytes, tables: dict[int, Huffman], before: int, low: int) -> None:
    flat = [c.coefs.reshape(-1, 64) for c, _, _ in parts]
    if before:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=blocks.size).reshape(blocks.shape)
        for i in range(len(parts)):
            own = which == i
            flat[i][blocks[:, own], 0] |= bits[:, own].astype(np.int16) << low
        return
    reader = Bits(data)
    symbol, signed = reader.symbol, reader.signed
    look = [tables[t] for _, t, _ in parts]
    each = which.tolist()
    diffs = np.fromiter((signed(symbol(look[i])) for _ in range(len(blocks)) for i in each), np.int64, blocks.size).reshape(blocks.shape)
    for i in range(len(parts)):
        own = which == i
        flat[i][blocks[:, own].ravel(), 0] = np.cumsum(diffs[:, own].ravel()) << low


def _ac_first(coefs: np.ndarray, blocks: np.ndarray, data: bytes, table: Huffman, first: int, last: int, low: int) -> None:
    wide = last - first + 1
    look = Bits(data)
    begins = look.symbol(table)
    size = begins & 15
    if begins >> 4 == 0 and size:  # perhaps all symbols are this one
        code, length = table.codes[begins]
        stride = length + size
        if len(data) == ceil(stride * len(blocks) * wide / 8) and _alike(coefs, blocks, data, code, stride, size, first, wide, low):
            return
        coefs[blocks, first : last + 1] = 0
    reader, ends = Bits(data), 0
    for b in blocks.tolist():
        if ends:
            ends -= 1
            continue
        k = first
        while k <= last:
            s = reader.symbol(table)
            run, size = s >> 4, s & 15
            if size:
                k += run
                coefs[b, k] = reader.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                ends = (1 << run) - 1 + reader.take(run)
                break


def _alike(coefs: np.ndarray, blocks: np.ndarray, data: bytes, code: int, stride: int, size: int, first: int, wide: int, low: int) -> bool:
    """Read a first scan whose symbols are all code, with size extra bits; False if they aren't."""
    for lo in range(0, len(blocks), SLICE_BLOCKS):
        part = blocks[lo : lo + SLICE_BLOCKS]
        count, at = len(part) * wide, lo * wide * stride // 8
        if stride == 8:
            raw = np.frombuffer(data, np.uint8, count, at)
        else:
            raw = np.unpackbits(np.frombuffer(data, np.uint8, ceil(stride * count / 8), at), count=stride * count).reshape(count, stride).astype(np.int32) @ (1 << np.arange(stride)[::-1])
        if not (raw >> size == code).all():
            return False
        extra = (raw & (1 << size) - 1).astype(np.int32)
        value = np.where(extra >> size - 1, extra, extra - (1 << size) + 1)
        coefs[part, first : first + wide] = (value << low).reshape(-1, wide)
    return True


def _ends_alike(coefs: np.ndarray, blocks: np.ndarray, data: bytes, code: int, length: int, first: int, wide: int, low: int) -> bool:
    """Read a refinement in which each block is an end of block and one bit for each coefficient; False if it isn't that."""
    stride = length + wide
    for write in (False, True):  # nothing is changed before all of it is seen to be so
        for lo in range(0, len(blocks), SLICE_BLOCKS):
            part = blocks[lo : lo + SLICE_BLOCKS]
            band = coefs[part, first : first + wide]
            bits = np.unpackbits(np.frombuffer(data, np.uint8, ceil(stride * len(part) / 8), lo * stride // 8), count=stride * len(part)).reshape(-1, stride)
            if write:
                coefs[part, first : first + wide] = band + np.sign(band) * (bits[:, length:].astype(np.int16) << low)
            elif not band.all() or (bits[:, :length] != [code >> length - 1 - i & 1 for i in range(length)]).any():
                return False
    return True


def _ac_refine(coefs: np.ndarray, blocks: np.ndarray, data: bytes, table: Huffman, first: int, last: int, low: int) -> None:
    wide = last - first + 1
    if 0 in table.codes:
        code, length = table.codes[0]
        if len(data) == ceil((length + wide) * len(blocks) / 8) and _ends_alike(coefs, blocks, data, code, length, first, wide, low):
            return
    reader, ends, one = Bits(data), 0, 1 << low

    def correct(b: int, k: int) -> None:
        if reader.take(1):
            coefs[b, k] += one if coefs[b, k] > 0 else -one

    for b in blocks.tolist():
        k = first
        while not ends and k <= last:
            s = reader.symbol(table)
            run, size = s >> 4, s & 15
            value = 0
            if size:
                value = one if reader.take(1) else -one
            elif run < 15:
                ends = (1 << run) + reader.take(run)
                break
            while k <= last:
                if coefs[b, k]:
                    correct(b, k)
                elif run:
                    run -= 1
                else:
                    if value:
                        coefs[b, k] = value
                    k += 1
                    break
                k += 1
        if ends:
            ends -= 1
            for j in range(k, last + 1):
                if coefs[b, j]:
                    correct(b, j)


def planes(image: Image) -> list[np.ndarray]:
    """The samples of each component at its own resolution."""
    out = []
    for c in image.components:
        rows, cols = c.coefs.shape[:2]
        if c.table not in image.quant:
            raise ValueError("a quantization table is missing")
        plane = np.empty((rows * 8, cols * 8), np.uint8)
        step = max(1, SLICE_BLOCKS // cols)
        for lo in range(0, rows, step):  # bounded memory
            part = c.coefs[lo : lo + step]
            square = np.empty((len(part) * cols, 64))
            square[:, ZIGZAG] = part.reshape(-1, 64) * image.quant[c.table]
            half = (square.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8)
            full = np.ascontiguousarray(half.transpose(0, 2, 1)).reshape(-1, 8) @ _BASIS.T
            samples = np.clip(np.floor((full + (1 << 2 * _SCALE - 1)) * 2.0 ** (-2 * _SCALE)) + 128, 0, 255).astype(np.uint8)
            # the second product leaves (block, x, y)
            plane[lo * 8 : (lo + len(part)) * 8] = samples.reshape(len(part), cols, 8, 8).transpose(0, 3, 1, 2).reshape(len(part) * 8, cols * 8)
        out.append(plane)
    return out


def rgb(image: Image) -> np.ndarray:
    """uint8 tensor (height, width, 3) at full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    if any(h % c.h or v % c.v for c in image.components):
        raise ValueError("sampling factors must divide the largest")
    parts = planes(image)
    out = np.empty((image.height, image.width, 3), np.uint8)
    step = v * max(1, (SLICE_BLOCKS << 6) // max(1, image.width * v))  # whole chroma rows
    for lo in range(0, image.height, step):  # bounded memory
        hi = min(image.height, lo + step)
        full = [np.repeat(np.repeat(p[lo * c.v // v : -(-hi * c.v // v)], v // c.v, axis=0), h // c.h, axis=1)[: hi - lo, : image.width] for c, p in zip(image.components, parts, strict=True)]
        if len(full) == 1:
            out[lo:hi] = full[0][:, :, None]
            continue
        y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
        # 1.402, 0.344136, 0.714136 and 1.772 times 2^16
        out[lo:hi, :, 0] = np.clip(y + (91881 * cr + 32768 >> 16), 0, 255)
        out[lo:hi, :, 1] = np.clip(y - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
        out[lo:hi, :, 2] = np.clip(y + (116130 * cb + 32768 >> 16), 0, 255)
    return out


_BYTE = np.arange(256)
_HIGH = np.where(_BYTE > 127, _BYTE >> 1, 127 - (255 - _BYTE >> 1)).astype(np.uint8)  # the code 0 and the upper extra bits
_LOW = np.where(_BYTE > 127, _BYTE & 1, 255 - _BYTE & 1).astype(np.uint8)
_DC_CODES = (bytes([0, 0, 0, 12]) + bytes(12), bytes(range(12)))
_FIRST_CODES = (bytes([1, 1]) + bytes(14), bytes([0x07, 0x00]))
_REFINE_CODES = (bytes([1, 1]) + bytes(14), bytes([0x00, 0x01]))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _tables() -> bytes:
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    return quant + _segment(0xC4, b"".join(bytes([n]) + counts + symbols for n, (counts, symbols) in ((0x00, _DC_CODES), (0x10, _FIRST_CODES), (0x11, _REFINE_CODES))))


_TABLES = _tables()


def _stuffed(bits: np.ndarray) -> bytes:
    tail = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(tail, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")


def _dc_bits(values: np.ndarray) -> np.ndarray:
    """Code and extra bits of each difference."""
    diff = np.diff(values, prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    word = size << size | np.where(diff >= 0, diff, diff + (1 << size) - 1)
    places = np.arange(15, -1, -1)
    return (word[:, None] >> places & 1)[places[None, :] < (size + 4)[:, None]].astype(np.uint8)


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """A progressive 4:2:0 JPEG file whose coefficients are the payload's bytes; n_bytes goes into the comment with the payload's size."""
    blocks = ceil(len(payload) / 64)
    mcus = ceil(blocks / 6)
    across = isqrt(mcus - 1) + 1
    down = ceil(mcus / across)
    if max(across, down) * 16 > 65535:
        raise ValueError("the payload is larger than a JPEG file can hold")
    grid = np.full((across * down * 6, 64), 255, np.uint8)
    grid.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", n_bytes, len(payload))), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    n = across * down
    parts = [(1, grid[: 4 * n]), (2, grid[4 * n : 5 * n]), (3, grid[5 * n :])]
    scan = lambda ident, table, first, last, approx, body: out.append(_segment(0xDA, bytes([1, ident, table, first, last, approx])) + body)
    for ident, b in parts:
        high = _HIGH[b]
        scan(ident, 0, 0, 0, 0x01, _stuffed(_dc_bits((b[:, 0].astype(np.int64) - 128) >> 1)))
        scan(ident, 0, 1, 5, 0x01, high[:, 1:6].tobytes())  # the upper bit is 0: no byte needs stuffing
        scan(ident, 0, 6, 63, 0x01, high[:, 6:].tobytes())
    for ident, b in parts:
        low = _LOW[b]
        scan(ident, 0, 0, 0, 0x10, _stuffed(b[:, 0] & 1))
        low[:, 0] = 0  # the code of an end of block
        scan(ident, 1, 1, 63, 0x10, np.packbits(low, axis=1).tobytes().replace(b"\xff", b"\xff\x00"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def decode_payload(image: Image) -> tuple[bytes, int]:
    """(payload, n_bytes) of a file that encode_payload made, from its coefficients."""
    n_bytes, size = struct.unpack(">QQ", image.comments[0])
    parts = []
    for x in image.components:
        flat = x.coefs.reshape(-1, 64)
        for lo in range(0, len(flat), SLICE_BLOCKS):
            c = flat[lo : lo + SLICE_BLOCKS]
            b = np.where(c > 0, c, c + 255).astype(np.uint8)
            b[:, 0] = c[:, 0] + 128
            parts.append(b.tobytes())
    return b"".join(parts)[:size], n_bytes


def describe(tensor: np.ndarray) -> str:
    """Size, channel means in thousandths and the mean step between neighbours of a row, from whole sums."""
    h, w = tensor.shape[:2]
    means = (int(s) * 1000 // (h * w) for s in tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    green = tensor[..., 1]
    steps = int((np.maximum(green[:, 1:], green[:, :-1]) - np.minimum(green[:, 1:], green[:, :-1])).sum(dtype=np.int64)) * 1000 // max(1, h * (w - 1))
    return f"{w}x{h}:{'.'.join(map(str, means))}:{steps}"


def to_media(docs: DataFrame, text: str = "text", media: str = "media", unit: int = UNIT) -> DataFrame:
    """docs with text replaced by media: its UTF-8 bytes, filled with bytes of 255 to a positive multiple of unit, as a JPEG file.
    An existing column of that name is replaced."""
    has_columns(docs, text)
    keep = [c for c in docs.columns if c != text and c.lower() != media.lower()]
    source = widened(docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias(fresh(docs, "_text"))))
    schema = source.select(*keep, F.lit(b"").alias(media)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jpeg")
        for batch in batches:
            for part in slices(batch, len(keep)):
                files = []
                for x in part.column(len(keep)):
                    raw = x.as_py()
                    files.append(encode_payload(raw + b"\xff" * (max(1, ceil(len(raw) / unit)) * unit - len(raw)), len(raw)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(files, pa.binary())], names=[*keep, media])
        release_memory()

    return source.mapInArrow(run, schema)


def read_media(stored: DataFrame, media: str = "media", tensor: bool = True, payload: bool = False) -> DataFrame:
    """stored plus height, width, feature; tensor adds rgb (binary, height x width x 3 bytes), payload adds n_bytes and payload
    of files that to_media made. Existing columns of these names are replaced."""
    has_columns(stored, media)
    new = {"height": "int", "width": "int", "feature": "string"} | ({"rgb": "binary"} if tensor else {}) | ({"n_bytes": "long", "payload": "binary"} if payload else {})
    keep = [c for c in stored.columns if c.lower() not in new]
    source = stored.select(*keep)
    schema = source.select("*", *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    at = keep.index(media)

    def row(x: bytes | None) -> list:
        if x is None:
            return [None] * len(new)
        image = decode(x)
        pixels = rgb(image)
        out = [image.height, image.width, describe(pixels)] + ([pixels.tobytes()] if tensor else [])
        return out + (list(decode_payload(image))[::-1] if payload else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jpeg")
        for batch in batches:
            for part in slices(batch, at):
                cols = list(zip(*(row(x.as_py()) for x in part.column(at)), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(c, kinds[t]) for c, t in zip(cols, new.values(), strict=True))], names=[*keep, *new])
        release_memory()

    return source.mapInArrow(run, schema)
