"""Progressive JPEG: a decoder, and a carrier that keeps bytes losslessly as coefficients.

The decoder (ITU-T T.81, progressive Huffman mode) accumulates every scan into coefficient arrays: first
and refining DC scans, spectral bands, successive approximation with runs of ended blocks. Runs
and tables of a single code are read as arrays; anything else goes bit by bit. Coefficients are
dequantised and transformed back by one matrix product, exactly (integer basis), chroma is
upsampled, and the result is a full-resolution RGB tensor.

JPEG samples can't hold bytes losslessly, but coefficients can: its unit here is the AC coefficient.
Category 8 (magnitudes 128 to 255, either sign) has 256 values, one for each byte. They are sent as
two spectral bands without their last bit, then refined. The image is 4:2:0, 63 bytes a block, filled
up with spaces; a comment holds the payload's length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stash, table

UNIT = 192
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_height int, rgb_width int, rgb binary"
NEXT_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient: along the diagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


#: The inverse transform's basis times 2 ** SCALE, rounded: coefficients (zigzag) to samples.
SCALE = 11
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
BASIS = np.rint(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[zigzag()] * (1 << SCALE))


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    blocks: np.ndarray | None = None  # (rows, columns, 64), zigzag order
    shown: tuple[int, int] = (0, 0)  # rows and columns of blocks that hold the image, without filling


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Codes:
    """A Huffman table: counts of codes by length, and their symbols in order."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.by_code: dict[tuple[int, int], int] = {}
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for k in range(n):
                self.by_code[length, code + k] = symbols[at + k]
            code, at = (code + n) << 1, at + n

    def only(self) -> tuple[int, int] | None:
        """(length, symbol) if there is a single code."""
        return (next(iter(self.by_code))[0], self.symbols[0]) if len(self.by_code) == 1 else None


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last].ljust(last - first, b"\xff"))
        self.at += n
        return word >> ((last << 3) - self.at) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next n bits as 0 and 1."""
        first = self.at >> 3
        raw = np.unpackbits(np.frombuffer(self.data, np.uint8, -1, first)[: (self.at - 8 * first + n + 7) >> 3])
        out = raw[self.at - 8 * first :][:n]
        self.at += n
        return out

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes.by_code:
                return codes.by_code[length, code]
        raise ValueError("no such code")


def signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def fixed(bits: Bits, length: int, size: int, n: int) -> np.ndarray:
    """n values of one category, each behind the same code."""
    width = length + size
    if width == 8 and bits.at % 8 == 0:
        words = np.frombuffer(bits.data, np.uint8, n, bits.at >> 3).astype(np.int32) & ((1 << size) - 1)
        bits.at += 8 * n
    else:
        words = bits.array(n * width).reshape(n, width)[:, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
    return np.where(words >> (size - 1), words, words - (1 << size) + 1) if size else words


def dc_scan(image: Image, chosen: list[tuple[Component, Codes]], ah: int, al: int, bits: Bits, units: range) -> None:
    """units: MCUs, or blocks if a single component is scanned."""
    alone = len(chosen) == 1
    order = []  # places of blocks, in the order of the stream
    columns = chosen[0][0].shown[1] if alone else chosen[0][0].blocks.shape[1] // chosen[0][0].h
    n = np.array(units)
    for k, (c, _) in enumerate(chosen):
        for y in range(1 if alone else c.v):
            for x in range(1 if alone else c.h):
                r, col = n // columns * (1 if alone else c.v) + y, n % columns * (1 if alone else c.h) + x
                order.append((k, r, col))
    if ah:
        new = bits.array(len(n) * len(order)).reshape(len(n), len(order)).astype(np.int32) << al
        for j, (k, r, col) in enumerate(order):
            chosen[k][0].blocks[r, col, 0] |= new[:, j]
        return
    if all(codes.only() and codes.only()[1] == 0 for _, codes in chosen):
        bits.at += len(n) * sum(chosen[k][1].only()[0] for k, *_ in order)
        for k, r, col in order:
            chosen[k][0].blocks[r, col, 0] = 0
        return
    last = [0] * len(chosen)
    for i in range(len(n)):
        for k, r, col in order:
            size = bits.symbol(chosen[k][1])
            last[k] += signed(bits.take(size), size)
            chosen[k][0].blocks[r[i], col[i], 0] = last[k] << al


def ac_first(flat: np.ndarray, codes: Codes, ss: int, se: int, al: int, bits: Bits) -> None:
    """flat: (blocks, 64) of the scan's component, in order."""
    only = codes.only()
    if only and only[1] >> 4 == 0 and only[1] & 15:
        values = fixed(bits, only[0], only[1] & 15, len(flat) * (se - ss + 1))
        flat[:, ss : se + 1] = (values << al).reshape(len(flat), -1)
        return
    run = 0
    for block in flat:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(bits.symbol(codes), 16)
            if s:
                k += r
                block[k] = signed(bits.take(s), s) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + bits.take(r)
                break


def correct(part: np.ndarray, al: int, bits: Bits) -> None:
    """One more bit for each value of part that isn't 0."""
    there = part != 0
    old = part[there]
    part[there] = old + np.sign(old) * (bits.array(len(old)).astype(np.int32) << al)


def ac_refine(flat: np.ndarray, codes: Codes, ss: int, se: int, al: int, bits: Bits) -> None:
    i = 0
    while i < len(flat):
        block, k = flat[i], ss
        run = 0
        while k <= se:
            r, s = divmod(bits.symbol(codes), 16)
            new = 0
            if s:
                new = (1 if bits.take(1) else -1) << al
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= se:
                if block[k]:
                    if bits.take(1):
                        block[k] += np.sign(block[k]) << al
                elif r == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            if k > ss:
                correct(block[k : se + 1], al, bits)
                i, run = i + 1, run - 1
            band = flat[i : i + run, ss : se + 1]
            correct(band, al, bits)
            i += run
        else:
            i += 1


def scan(image: Image, header: bytes, dc: dict[int, Codes], ac: dict[int, Codes], restart: int, data: bytes) -> None:
    count = header[0]
    by_number = {c.number: c for c in image.components}
    picked = [(by_number[header[1 + 2 * k]], header[2 + 2 * k]) for k in range(count)]
    ss, se, (ah, al) = header[1 + 2 * count], header[2 + 2 * count], divmod(header[3 + 2 * count], 16)
    first = picked[0][0]
    if count == 1:
        total = first.shown[0] * first.shown[1]
    else:
        total = first.blocks.shape[0] // first.v * (first.blocks.shape[1] // first.h)
    parts = RESTART.split(data) if restart else [data]
    shown = first.blocks[: first.shown[0], : first.shown[1]]
    flat = np.ascontiguousarray(shown).reshape(-1, 64) if ss else None
    for k, part in enumerate(parts):
        bits = Bits(part.replace(b"\xff\x00", b"\xff"))
        units = range(k * restart, min(total, (k + 1) * restart)) if restart else range(total)
        if ss == 0:
            dc_scan(image, [(c, dc.get(t >> 4)) for c, t in picked], ah, al, bits, units)
        else:
            (ac_refine if ah else ac_first)(flat[units.start : units.stop], ac[picked[0][1] & 15], ss, se, al, bits)
    if ss:
        first.blocks[: first.shown[0], : first.shown[1]] = flat.reshape(shown.shape)


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    image, at, dc, ac, restart = Image(), 2, {}, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = divmod(body[0], 16)
                n = 64 * (1 + wide)
                image.quants[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                kind, number = divmod(body[0], 16)
                n = sum(body[1:17])
                (ac if kind else dc)[number] = Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body)
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
            for c in image.components:
                c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)
                c.shown = (-(-(-(-image.height * c.v // top_v)) // 8), -(-(-(-image.width * c.h // top_h)) // 8))
        elif marker == 0xDA:
            end = NEXT_MARKER.search(data, at)
            stop = end.start() if end else len(data)
            scan(image, body, dc, ac, restart, data[at:stop])
            at = stop
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman JPEG")
    return image


def plane(image: Image, c: Component) -> np.ndarray:
    values = c.blocks.reshape(-1, 64) * image.quants[c.quant]
    # Integers below 2 ** 24 are exact in single precision, whatever the order of the sum.
    exact = np.float32 if int(np.abs(values).max(initial=0)) <= 255 else np.float64
    samples = values.astype(exact) @ BASIS.astype(exact)
    samples = np.floor((samples + (1 << (SCALE - 1))) / (1 << SCALE)) + 128
    rows, columns = c.blocks.shape[:2]
    return np.clip(samples, 0, 255).astype(np.uint8).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) or (height, width, 1) of unsigned bytes."""
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)

    def shown(c: Component) -> np.ndarray:
        p = plane(image, c)
        if top_h % c.h or top_v % c.v:
            # Factors that don't divide: each pixel takes the sample that covers it.
            return p[np.arange(image.height) * c.v // top_v][:, np.arange(image.width) * c.h // top_h]
        return np.repeat(np.repeat(p, top_v // c.v, 0), top_h // c.h, 1)[: image.height, : image.width]

    planes = [shown(c) for c in image.components]
    if len(planes) == 1:
        return planes[0][:, :, None]
    # The JFIF colour matrix times 2 ** 16.
    y, cb, cr = (p.astype(np.int32) for p in planes)
    y, cb, cr = (y << 16) + 32768, cb - 128, cr - 128
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body


#: DC 0: category 0 alone. AC 0: run 0, category 7 alone. AC 1: ends of 2 ** 0 to 2 ** 14 blocks, four bits each.
_TABLES = segment(0xC4, bytes([0x00, 1, *[0] * 15, 0x00]) + bytes([0x10, 1, *[0] * 15, 0x07]) + bytes([0x11, 0, 0, 0, 15, *[0] * 12, *[r << 4 for r in range(15)]]))
_QUANT = segment(0xDB, bytes([0] + [1] * 64))


def carry(payload: bytes) -> bytes:
    """A progressive JPEG whose AC coefficients are the payload's bytes."""
    units = max(1, -(-len(payload) // (6 * 63)))
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    n = across * down
    data = np.frombuffer(payload.ljust(n * 6 * 63), np.uint8)
    parts = [data[: n * 252].reshape(-1, 63), data[n * 252 : n * 315].reshape(-1, 63), data[n * 315 :].reshape(-1, 63)]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), _QUANT, segment(0xC2, frame), _TABLES]
    zeros = (6 * n + 7) // 8
    filled = bytearray(zeros)
    if 6 * n % 8:
        filled[-1] = (1 << (8 - 6 * n % 8)) - 1
    out += [segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x01])), bytes(filled)]
    for number, part in enumerate(parts, 1):
        for ss, se in ((1, 5), (6, 63)):
            # A code of one bit (0), then seven bits of the value: the byte without its last bit.
            out += [segment(0xDA, bytes([1, number, 0x00, ss, se, 0x01])), (part[:, ss - 1 : se] >> 1).tobytes()]
    out += [segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), bytes(filled)]
    for number, part in enumerate(parts, 1):
        # Of negative values the magnitude's last bit is the opposite of the byte's.
        last = ((part & 1) ^ (part < 128)).reshape(-1)
        bits = []
        for at in range(0, len(part), 32767):
            run = min(32767, len(part) - at)
            r = run.bit_length() - 1
            head = f"{r:04b}" + (f"{run - (1 << r):0{r}b}" if r else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, last[at * 63 : (at + run) * 63]]
        bits = np.concatenate(bits)
        packed = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
        out += [segment(0xDA, bytes([1, number, 0x01, 1, 63, 0x10])), packed.replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


def carried(image: Image) -> bytes:
    """The payload of carry()'s image."""
    size = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    values = np.concatenate([c.blocks[:, :, 1:].reshape(-1) for c in image.components])[:size]
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Size, mean colour in thousandths, and a histogram of the first channel in eighths, in thousandths of all pixels."""
    pixels = tensor.shape[0] * tensor.shape[1]
    means = tensor.reshape(pixels, -1).sum(0, dtype=np.int64) * 1000 // pixels
    bars = np.bincount(tensor[:, :, 0].reshape(-1) >> 5, minlength=8) * 1000 // pixels
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{','.join(map(str, means.tolist()))}:{','.join(map(str, bars.tolist()))}"


def media_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, JPEG that carries it, filled up with spaces to a positive multiple of UNIT)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), carry(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT))


def rgb_tensors(media: DataFrame) -> DataFrame:
    """id, height, width, channels, rgb (bytes, row by row) for rows (id, media: a progressive JPEG).

    Null media: nulls. A file that isn't a progressive Huffman JPEG: nulls. Other columns are ignored.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    t = rgb(decode(data))
                    rows.append((*t.shape, t.tobytes()))
                except (ValueError, TypeError, IndexError, KeyError, struct.error):
                    rows.append((None, None, None, None))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]], names=["id", "height", "width", "channels", "rgb"])

    return media.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(run, "id long, height int, width int, channels int, rgb binary")


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row of docs (doc_id, text): each text as the JPEG that carries it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [media_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of docs (doc_id, text): each text is stored as media in a table of the shared folder, read
    back from there and decoded to a full-resolution tensor: rgb_height, rgb_width, rgb (bytes, row by row).

    Null or empty text: UNIT spaces. Null doc_id and repeated rows: rows like any other. An empty table
    gives no rows. Other columns are ignored.
    """
    media = stash(media_table(docs), "media", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for doc_id, size, media in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    image = decode(media)
                    payload, tensor = carried(image), rgb(image)
                    rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor), *tensor.shape[:2], tensor.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return media.mapInArrow(run, SCHEMA)


def op2_progressive_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
