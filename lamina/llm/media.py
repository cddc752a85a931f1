"""Media columns of progressive JPEG (operator 8).

The decoder reads progressive (SOF2) files: spectral-selection and successive-approximation scans are
accumulated into coefficient arrays, which are dequantised and inverse-transformed in numpy; chroma is
upsampled by repetition and the result is a full-resolution RGB tensor.

A payload of bytes is carried losslessly by the format's own unit, the coefficients: each byte becomes a
place in the file's table of used bytes (a comment segment), and the place v of s bits becomes the
coefficient whose magnitude bits are v, of category s (7 for up to 128 distinct bytes, else 8). No
coefficient is zero, so each AC scan has one Huffman symbol and codes of one length; scans of that kind
are unpacked as arrays, all others symbol by symbol. Wide arrays (a byte for each bit, planes of floats) are made
for strips of blocks, so memory is a small multiple of the file and its tensor.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 64
#: Zigzag order: along antidiagonals, turning at each end.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_DCT = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)
#: MCUs in a row of an image that carries a payload; each MCU is 16 x 16 pixels, 4 + 1 + 1 blocks.
ROW = 64
#: Blocks whose bits, and rows of MCUs whose planes, are made at once; a multiple of 8, so that strips end at bytes.
STRIP = 4096
#: AC coefficients that are sent in two approximations, and the rest.
LOW, HIGH = (1, 5), (6, 63)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table in which all symbols have codes of one length."""
    return _segment(0xC4, bytes([kind]) + bytes(len(symbols) if i == length else 0 for i in range(1, 17)) + bytes(symbols))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each value, highest first, as an array (n, width) of 0 and 1."""
    return np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :]


def _padded_bits(bits: np.ndarray) -> bytes:
    """Bits as bytes, padded by ones."""
    data, pad = np.packbits(bits).tobytes(), -len(bits) % 8
    return data[:-1] + bytes([data[-1] | (1 << pad) - 1]) if pad else data


@functools.lru_cache(256)
def _scan_head(components: tuple, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([start, end, high << 4 | low]))


def _scan(components: tuple, start: int, end: int, high: int, low: int, bits: np.ndarray | bytes) -> bytes:
    data = bits if isinstance(bits, bytes) else _padded_bits(bits)
    return _scan_head(components, start, end, high, low) + data.replace(b"\xff", b"\xff\x00")


@functools.lru_cache(4)
def _tables(s: int) -> bytes:
    return _table(0x00, list(range(12)), 4) + _table(0x10, [s - 1], 1) + _table(0x11, [s], 1) + _table(0x12, [0], 1)


@functools.lru_cache(512)
def _mcu_order(rows: int, cols: int, sampling: tuple[int, int]) -> np.ndarray:
    """Places, in a component of rows x cols MCUs, of its blocks in the order of interleaved scans: (MCU, block)."""
    v, h = sampling
    grid = np.arange(rows * v * cols * h).reshape(rows, v, cols, h)
    return grid.transpose(0, 2, 1, 3).reshape(rows * cols, v * h)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG file (4:2:0) whose coefficients carry payload, of any length."""
    raw = np.frombuffer(payload, np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256)).astype(np.uint8)
    if not len(used):
        used = np.zeros(1, np.uint8)
    s = 7 if len(used) <= 128 else 8
    place = np.zeros(256, np.int16)
    place[used] = np.arange(len(used))
    n = max(1, -(-len(raw) // BLOCK))
    mcus = -(-n // 6)
    cols = min(mcus, max(ROW, -(-mcus // 4000)))
    rows = -(-mcus // cols)
    mcus = rows * cols
    v = np.zeros((mcus * 6, BLOCK), np.int16)
    v.reshape(-1)[: len(raw)] = place[raw]
    parts = [v[: 4 * mcus], v[4 * mcus : 5 * mcus], v[5 * mcus :]]
    half, full = 1 << (s - 1), (1 << s) - 1
    orders = [_mcu_order(rows, cols, x) for x in ((2, 2), (1, 1), (1, 1))]
    # DC: c = v or v - full; first c >> 1 as differences, later the low bit
    dc = [(np.where(p[:, 0] >= half, p[:, 0], p[:, 0] - full)) for p in parts]
    diff = []
    for c, o in zip(dc, orders):
        x = (c >> 1)[o].reshape(-1)
        y = x.copy()
        y[1:] -= x[:-1]
        diff.append(y.reshape(o.shape))
    d = np.concatenate(diff, axis=1).reshape(-1).astype(np.int64)
    size = np.zeros(len(d), np.int64)
    nonzero = d != 0
    size[nonzero] = np.floor(np.log2(np.abs(d[nonzero]))).astype(np.int64) + 1
    extra = np.where(d > 0, d, d + (1 << size) - 1)
    code = (size << size) | np.where(size > 0, extra, 0)  # a code of 4 bits, then size bits
    wide = np.unpackbits(code.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    dc_bits = wide[np.arange(32)[None, :] >= (28 - size)[:, None]]
    low = np.concatenate([(c & 1)[o] for c, o in zip(dc, orders)], axis=1).reshape(-1).astype(np.uint8)
    out = [
        b"\xff\xd8", _segment(0xFE, struct.pack(">QB", len(payload), len(used) - 1) + used.tobytes()), _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _tables(s),
    ]
    out.append(_scan(((1, 0), (2, 0), (3, 0)), 0, 0, 0, 1, dc_bits))
    a, b = LOW
    for i, p in enumerate(parts):
        x = p[:, a : b + 1]
        # |c| >> 1 with its sign, as magnitude bits of category s - 1
        magnitude = np.where(x >= half, x, full - x)
        first = np.where(x >= half, magnitude >> 1, (full >> 1) - (magnitude >> 1))
        bits = np.zeros((x.size, s), np.uint8)
        bits[:, 1:] = _bits(first.reshape(-1), s - 1)
        out.append(_scan(((i + 1, 0x00),), a, b, 0, 1, bits.reshape(-1)))
        rest = p[:, HIGH[0] :]  # a code and its magnitude bits are one byte if s is 7
        out.append(_scan(((i + 1, 0x01),), *HIGH, 0, 0, rest.astype(np.uint8).tobytes() if s == 7 else b"".join(_padded_bits(_bits(rest[k : k + STRIP].reshape(-1), s + 1).reshape(-1)) for k in range(0, len(rest), STRIP))))
        fix = np.zeros((len(p), b - a + 2), np.uint8)
        fix[:, 1:] = magnitude & 1
        out.append(_scan(((i + 1, 0x02),), a, b, 1, 0, fix.reshape(-1)))
    out.append(_scan(((1, 0), (2, 0), (3, 0)), 0, 0, 1, 0, low))
    return b"".join(out) + b"\xff\xd9"


@functools.lru_cache(512)
def _grid(all_rows: int, all_cols: int, rows: int, cols: int) -> np.ndarray:
    """Places of the blocks that a scan of one component has."""
    return np.arange(all_rows * all_cols).reshape(all_rows, all_cols)[:rows, :cols].reshape(-1, 1)


class _Reader:
    """Bits of an entropy-coded part."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 4, 0

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        x = self.peek16() >> (16 - n)
        self.at += n
        return x

    def symbol(self, table: list[tuple[int, int]]) -> int:
        length, symbol = table[self.peek16()]
        if not length:
            raise ValueError("broken Huffman code")
        self.at += length
        return symbol


def _extend(x: int, s: int) -> int:
    return x if not s or x >> (s - 1) else x - (1 << s) + 1


@functools.lru_cache(16)
def _lookups(codes: tuple[bytes, bytes]) -> list[tuple[int, int]]:
    """(length, symbol) for each 16 bits; length 0 where no code matches."""
    table, code, i = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(codes[0], 1):
        for _ in range(n):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [(length, codes[1][i])] * (1 << (16 - length))
            code, i = code + 1, i + 1
        code <<= 1
    return table


@functools.lru_cache(16)
def _differences(codes: tuple[bytes, bytes]) -> list[tuple[int, int | None]]:
    """(length with magnitude bits, difference) for each 16 bits; (size and code length, None) if they are more."""
    out: list[tuple[int, int | None]] = []
    for w, (length, s) in enumerate(_lookups(codes)):
        if length + s <= 16:
            out.append((length + s if length else 0, _extend(w >> (16 - length - s) & (1 << s) - 1, s)))
        else:
            out.append((s << 8 | length, None))
    return out


class Decoder:
    """Decodes one progressive file: coefficients (component -> array (rows, cols, 64) in zigzag order)."""

    def __init__(self, data: bytes, arrays: bool = True):
        self.arrays, self.quant, self.huffman, self.codes, self.single = arrays, {}, {}, {}, {}
        self.coefficients: dict[int, np.ndarray] = {}
        self.sampling: dict[int, tuple[int, int, int]] = {}
        self.comment, self.interval, at = b"", 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker = data[at + 1]
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            if marker == 0xD9:
                break
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                at = self._scan(body, data, at)
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only progressive Huffman files are read")

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
            body = body[1 + n :]

    def _codes(self, body: bytes) -> None:
        while body:
            key, counts = body[0], body[1:17]
            n = sum(counts)
            self.single[key] = body[17] if n == 1 and counts[0] == 1 else None
            self.huffman[key] = self.codes[key] = (counts, body[17 : 17 + n])
            body = body[17 + n :]

    def _lookup(self, key: int) -> list[tuple[int, int]]:
        found = self.huffman[key]
        if isinstance(found, tuple):
            found = self.huffman[key] = _lookups(found)
        return found

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.sampling[c] = (hv >> 4, hv & 15, q)
        self.h, self.v = max(s[0] for s in self.sampling.values()), max(s[1] for s in self.sampling.values())
        self.cols, self.rows = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c, (h, v, _) in self.sampling.items():
            self.coefficients[c] = np.zeros((self.rows * v, self.cols * h, 64), np.int16)

    def _scan(self, head: bytes, data: bytes, at: int) -> int:
        n = head[0]
        own = [(head[1 + 2 * i], head[2 + 2 * i]) for i in range(n)]
        start, end, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        # the data ends at the first marker other than a stuffed zero or a restart
        parts, first, look = [], at, at
        while True:
            look = data.index(b"\xff", look)
            m = data[look + 1]
            if m == 0:
                look += 2
            elif 0xD0 <= m <= 0xD7:
                parts.append(data[first:look])
                look = first = look + 2
            else:
                parts.append(data[first:look])
                break
        parts = [p.replace(b"\xff\x00", b"\xff") for p in parts]
        if n == 1:
            c = own[0][0]
            h, v, _ = self.sampling[c]
            rows, cols = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
            units = [(c, own[0][1], _grid(*self.coefficients[c].shape[:2], rows, cols))]
        else:
            units = [(c, t, _mcu_order(self.rows, self.cols, self.sampling[c][1::-1])) for c, t in own]
        if self.arrays and len(parts) == 1:
            if start == 0 and high:
                self._dc_refine(units, parts[0], low)
                return look
            if start and self._ac_single(units[0], parts[0], start, end, high, low):
                return look
        mcus = len(units[0][2])
        step = self.interval or mcus
        for i, part in enumerate(parts):
            self._symbols(units, part, range(i * step, min(mcus, (i + 1) * step)), start, end, high, low)
        return look

    def _dc_refine(self, units: list, part: bytes, low: int) -> None:
        order = [o.shape[1] for _, _, o in units]
        n = len(units[0][2]) * sum(order)
        bits = np.unpackbits(np.frombuffer(part, np.uint8), count=n).reshape(-1, sum(order)).astype(np.int16)
        at = 0
        for (c, _, o), k in zip(units, order):
            self.coefficients[c].reshape(-1, 64)[o, 0] |= bits[:, at : at + k] << low
            at += k

    def _ac_single(self, unit: tuple, part: bytes, start: int, end: int, high: int, low: int) -> bool:
        """A scan with one symbol of one bit: (run 0, size s) throughout, or an end of block with correction bits."""
        c, t, order = unit
        symbol = self.single.get(0x10 | (t & 15))
        flat = self.coefficients[c].reshape(-1, 64)
        m, count = end - start + 1, len(order)
        blocks = slice(None) if count == len(flat) else order[:, 0]
        bits = np.frombuffer(part, np.uint8)
        if symbol and not high and symbol < 16:
            s = symbol
            if s > 8 or len(bits) * 8 < count * m * (s + 1):
                return False
            for first in range(0, count, STRIP):  # strips begin at whole bytes
                n, at = min(STRIP, count - first) * m, first * m * (s + 1) // 8
                if s == 7:  # a code and its magnitude bits are one byte
                    v = bits[at : at + n].astype(np.int16)
                else:
                    own = np.unpackbits(bits[at : at + -(-n * (s + 1) // 8)], count=n * (s + 1))
                    v = np.packbits(own.reshape(n, s + 1)[:, 1:], axis=1).reshape(-1).astype(np.int16) >> (8 - s)
                v -= (v < 1 << (s - 1)) * np.int16((1 << s) - 1)
                where = slice(first, first + n // m) if isinstance(blocks, slice) else blocks[first : first + n // m]
                flat[where, start : end + 1] = (v << low).reshape(-1, m)
            return True
        if symbol == 0 and high:
            x = flat[blocks, start : end + 1]
            if not (x != 0).all() or len(bits) * 8 < count * (m + 1):
                return False
            fix = np.unpackbits(bits, count=count * (m + 1)).reshape(-1, m + 1)[:, 1:].astype(np.int16) << low
            flat[blocks, start : end + 1] = np.where(x > 0, x + fix, x - fix)
            return True
        return False

    def _dc_first(self, units: list, part: bytes, mcus: range, low: int) -> None:
        """First DC scan: one lookup of 16 bits gives a code with its magnitude bits, where they fit."""
        data, at, count = part + b"\xff" * 8, 0, [u[2].shape[1] for u in units]
        tables = [_differences(self.codes[u[1] >> 4]) for u in units for _ in range(u[2].shape[1])]
        found = []
        for _ in mcus:
            for table in tables:
                i = at >> 3
                length, value = table[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (at & 7)) & 0xFFFF]
                if value is None:  # more than 16 bits together
                    s, w = length >> 8, int.from_bytes(data[i : i + 6], "big")
                    length = (length & 255) + s
                    value = _extend(w >> (48 - (at & 7) - length) & (1 << s) - 1, s)
                if not length:
                    raise ValueError("broken Huffman code")
                at += length
                found.append(value)
        d, k = np.array(found, np.int64).reshape(-1, len(tables)), 0
        for (c, _, order), n in zip(units, count):
            values = np.cumsum(d[:, k : k + n].reshape(-1)) << low
            self.coefficients[c].reshape(-1, 64)[order[mcus.start : mcus.stop].reshape(-1), 0] = values
            k += n

    def _symbols(self, units: list, part: bytes, mcus: range, start: int, end: int, high: int, low: int) -> None:
        """Decodes MCUs of a scan symbol by symbol."""
        r = _Reader(part)
        if start == 0 and not high:
            return self._dc_first(units, part, mcus, low)
        if start == 0:
            for i in mcus:
                for c, _, order in units:
                    for b in order[i].tolist():
                        self.coefficients[c].reshape(-1, 64)[b, 0] |= r.take(1) << low
            return
        c, t, order = units[0]
        table, flat, run = self._lookup(0x10 | (t & 15)), self.coefficients[c].reshape(-1, 64), 0
        for i in mcus:
            block = flat[order[i, 0]]
            k = start
            if not high:
                if run:
                    run -= 1
                    continue
                while k <= end:
                    rs = r.symbol(table)
                    zeros, s = rs >> 4, rs & 15
                    if s:
                        k += zeros
                        block[k] = _extend(r.take(s), s) << low
                        k += 1
                    elif zeros == 15:
                        k += 16
                    else:
                        run = (1 << zeros) + r.take(zeros) - 1
                        break
                continue
            bit = 1 << low

            def correct(k: int) -> None:
                if r.take(1) and not abs(int(block[k])) & bit:
                    block[k] += bit if block[k] > 0 else -bit

            if not run:
                while k <= end:
                    rs = r.symbol(table)
                    zeros, s = rs >> 4, rs & 15
                    new = 0
                    if s:
                        new = bit if r.take(1) else -bit
                    elif zeros < 15:
                        run = (1 << zeros) + r.take(zeros)
                        break
                    while k <= end:
                        if block[k]:
                            correct(k)
                        elif zeros == 0:
                            if new:
                                block[k] = new
                            k += 1
                            break
                        else:
                            zeros -= 1
                        k += 1
            if run:
                for j in range(k, end + 1):
                    if block[j]:
                        correct(j)
                run -= 1

    def rgb(self) -> np.ndarray:
        """The image as uint8 (height, width, 3): inverse transform, upsampled chroma, YCbCr to RGB."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        step = max(1, STRIP // max(1, self.cols * self.h * self.v))
        for first in range(0, self.rows, step):
            part = out[first * 8 * self.v : (first + step) * 8 * self.v]
            if len(part):
                self._strip(part, first, min(self.rows, first + step))
        return out

    def _strip(self, out: np.ndarray, first: int, last: int) -> None:
        """Fills the pixels of rows of MCUs."""
        planes = []
        for c, (h, v, q) in self.sampling.items():
            z = self.coefficients[c][first * v : last * v].astype(np.float32) * self.quant[q]
            rows, cols = z.shape[:2]
            x = np.empty_like(z)
            x[:, :, ZIGZAG] = z
            x = _DCT.T @ x.reshape(-1, 8, 8) @ _DCT
            plane = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            planes.append(plane.repeat(self.v // v, axis=0).repeat(self.h // h, axis=1)[: len(out), : self.width])
        y = planes[0] + np.float32(128.5)
        if len(planes) < 3:
            out[:] = np.clip(y, 0, 255)[:, :, None]
            return
        cb, cr = planes[1], planes[2]
        out[:, :, 0] = np.clip(y + np.float32(1.402) * cr, 0, 255)
        out[:, :, 1] = np.clip(y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, 0, 255)
        out[:, :, 2] = np.clip(y + np.float32(1.772) * cb, 0, 255)

    def payload(self) -> bytes:
        """The bytes that encode_payload was given."""
        size, n = struct.unpack_from(">QB", self.comment)
        used = np.frombuffer(self.comment, np.uint8, n + 1, 9)
        full = (1 << (7 if len(used) <= 128 else 8)) - 1
        out = []
        for x in self.coefficients.values():
            flat = x.reshape(-1)
            for first in range(0, min(len(flat), size), STRIP * BLOCK):
                c = flat[first : min(size, first + STRIP * BLOCK)]
                out.append(used[np.where(c > 0, c, c + full)].tobytes())
            size -= min(size, len(flat))
        return b"".join(out)


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % BLOCK or (BLOCK if not data else 0))


def store_media(docs: DataFrame) -> DataFrame:
    """Stored table doc_id, n_bytes, media: each text (null: empty) as a progressive JPEG file in a binary column."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_slices(batches, 1 << 20):
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([encode_payload(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    path = common.shared_path(docs.sparkSession, "media")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def feature(x: np.ndarray) -> str:
    """A tensor's size and its mean RGB."""
    return f"{x.shape[1]}x{x.shape[0]} " + " ".join(f"{v:.2f}" for v in x.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (x.shape[0] * x.shape[1]))


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media digests, the feature, and the tensor itself (height, width, rgb: row-major
    uint8) of every row of a media table (doc_id, n_bytes, media), from the stored files. Rows leave in parts of a few MB."""
    kinds = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

        for batch in batches:
            for i, n, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                d = Decoder(m)
                p, x = d.payload(), d.rgb()
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(x), *x.shape[:2], x.tobytes()))
                size += x.nbytes
                if size > 4 << 20:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as media and computes features() from what is read back; the full-resolution
    RGB tensors are a column of the result, stored where the result is stored.

    Null and empty texts are 64 zero bytes; rows of equal or null ids stay rows of their own; an empty table gives an
    empty result; other columns of docs are ignored; no shuffle."""
    return features(store_media(docs))
