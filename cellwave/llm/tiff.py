"""TIFF as media columns: files of grey or multi-sample pages, written and read.

The reader walks the image directories, decodes PackBits, LZW or deflate strips
and tiles, undoes the horizontal predictor and gives one row per page. Samples
of 8 or 16 bits, interleaved, are read; bits 1 and 4, planes of their own, the
floating-point predictor and other compressions give an error row. Sizes that
a file states are held against the file before anything is made of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.arrow import STEP_BYTES, steps

#: Fixed values of the TIFF 6.0 format: compression schemes, tags and the bytes of its field types.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_BYTES = {1: "B", 3: "H", 4: "I", 16: "Q"}
CLEAR, END = 256, 257

#: Bytes, at most, that a byte of a coded strip stands for: deflate's and PackBits' longest matches, LZW's longest entries.
GROWTH = {NONE: 1, PACKBITS: 64, DEFLATE: 1040, OLD_DEFLATE: 1040, LZW: 2731}

#: Bytes of a page's samples, at most, unless ``tiff_pages`` is told otherwise; a larger page is an error row.
PAGE_BYTES = 1 << 28

#: Every byte with its bits in reverse order.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


class TiffError(ValueError):
    pass


def lzw_encode(data: bytes) -> bytes:
    """Codes as ``lzw_decode`` reads them; the table is cleared before it is full."""
    out, table = bytearray(), {}  # a longer string's code by its prefix's code and last byte
    bits, n_bits, width, following = CLEAR, 9, 9, 258
    code = data[0] if data else -1
    for byte in memoryview(data)[1:]:
        key = code << 8 | byte
        longer = table.get(key)
        if longer is not None:
            code = longer
            continue
        bits, n_bits = bits << width | code, n_bits + width
        table[key] = following
        following += 1
        if following == 4094:
            bits, n_bits = bits << width | CLEAR, n_bits + width
            table.clear()
            width, following = 9, 258
        elif following >= 1 << width:
            width += 1
        code = byte
        if n_bits >= 1024:
            keep = n_bits % 8
            out += (bits >> keep).to_bytes(n_bits // 8, "big")
            bits, n_bits = bits & ((1 << keep) - 1), keep
    if code >= 0:
        bits, n_bits = bits << width | code, n_bits + width
        if following + 1 >= 1 << width and width < 12:
            width += 1
    bits, n_bits = bits << width | END, n_bits + width
    spare = -n_bits % 8
    out += (bits << spare).to_bytes((n_bits + spare) // 8, "big")
    return bytes(out)


#: The strings of the codes that stand for one byte; two codes are no strings.
SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, most: int) -> bytes:
    """Codes go most significant bit first and widen one code early; stops at the end code or after ``most`` bytes."""
    table, width, wider, previous = list(SINGLE), 9, 511, b""
    out, size, following = [], 0, 258
    bits, n_bits, at, total = 0, 0, 0, len(data)
    while size < most:
        if n_bits < width:
            chunk = data[at : at + 64]
            at += 64
            bits, n_bits = bits << (8 * len(chunk)) | int.from_bytes(chunk, "big"), n_bits + 8 * len(chunk)
            if n_bits < width:
                break
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, wider, previous, following = list(SINGLE), 9, 511, b"", 258
            continue
        if code < following:
            entry = table[code]
        elif code == following and previous:
            entry = previous + previous[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if previous:
            table.append(previous + entry[:1])
            following += 1
            if following >= wider and width < 12:
                width, wider = width + 1, 2 * wider + 1
        previous = entry
    return b"".join(out)


def packbits_encode(row: np.ndarray) -> bytes:
    """One row: runs of three and more as runs, the rest as literals."""
    n = len(row)
    if not n:
        return b""
    edges = np.flatnonzero(np.diff(row)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.concatenate((starts, [n])))
    raw, out, at = row.tobytes(), bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = raw[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, length in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist()):
        literal(s)
        for i in range(0, length, 128):
            k = min(128, length - i)
            out.extend((257 - k, raw[s]) if k > 1 else (0, raw[s]))
        at = s + length
    literal(n)
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    out, at, size, total = [], 0, 0, len(data)
    while at < total and size < most:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        size += len(part)
    return b"".join(out)


def unpack(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise TiffError(str(e)) from None
    raise TiffError(f"compression {compression} is not supported")


def pack(block: np.ndarray, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(block.tobytes())
    if compression == PACKBITS:
        return b"".join(packbits_encode(r) for r in block)
    if compression == DEFLATE:
        return zlib.compress(block.tobytes(), 1)
    return block.tobytes()


def write_tiff(pages: list[dict]) -> bytes:
    """A little-endian file of 8-bit grey pages: dicts of pixels (2-D), compression, predictor, and rows (of a strip) or tile (width, length)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        pixels, compression, predictor = page["pixels"], page["compression"], page.get("predictor", 1)
        h, w = pixels.shape
        tile = page.get("tile")
        if tile:
            tw, tl = tile
            full = np.zeros((-(-h // tl) * tl, -(-w // tw) * tw), np.uint8)
            full[:h, :w] = pixels
            blocks = [full[y : y + tl, x : x + tw] for y in range(0, full.shape[0], tl) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [pixels[y : y + page["rows"]] for y in range(0, h, page["rows"])]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            coded = pack(np.ascontiguousarray(block), compression)
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[0]]), (TILE_LENGTH, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [page["rows"]]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{FIELD_BYTES[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed
                packed = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory; a directory that links back ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            raise TiffError("not a TIFF file")
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}H", data, at)
            fields = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
                if kind not in FIELD_BYTES:
                    continue
                form = f"{order}{count}{FIELD_BYTES[kind]}"
                where = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(f"{order}I", data, where)
                fields[tag] = struct.unpack_from(form, data, where)
            yield order, fields
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("the file ends early") from None


def read_page(data: bytes, order: str, fields: dict[int, tuple], most: int = PAGE_BYTES) -> dict:
    def one(tag: int, default: int | None = None) -> int:
        found = fields.get(tag) or (() if default is None else (default,))
        if not found:
            raise TiffError(f"tag {tag} is missing")
        return found[0]

    w, h, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits not in (8, 16) or set(fields.get(BITS, ())) > {bits} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise TiffError("only interleaved samples of 8 or 16 bits, plain or with the horizontal predictor, are supported")
    fill = one(FILL_ORDER, 1)
    if fill not in (1, 2):
        raise TiffError(f"fill order {fill} is not known")
    if compression not in GROWTH:
        raise TiffError(f"compression {compression} is not supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in fields
    bw, bl = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
    if min(w, h, samples, bw, bl) < 1:
        raise TiffError("a page without samples")
    offsets, counts = (fields.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    blocks = -(-h // bl) * -(-w // bw)
    if len(offsets) < blocks or len(counts) < blocks:
        raise TiffError("strips or tiles are missing")
    stored = blocks * bl * bw * samples * kind.itemsize if tiled else h * w * samples * kind.itemsize
    if stored > GROWTH[compression] * sum(min(c, len(data)) for c in counts[:blocks]):
        raise TiffError("the page is larger than its strips or tiles can hold")
    if stored > most:
        raise TiffError(f"the page is larger than {most} bytes")
    places = [(y, x) for y in range(0, h, bl) for x in range(0, w, bw)]
    page = np.zeros((h, w, samples), kind)
    for (y, x), offset, count in zip(places, offsets, counts):
        rows = bl if tiled else min(bl, h - y)
        need = rows * bw * samples * kind.itemsize
        coded = data[offset : offset + count]
        raw = unpack(coded.translate(REVERSED) if fill == 2 else coded, compression, need)
        if len(raw) < need:
            raise TiffError("a strip or tile ends early")
        block = np.frombuffer(raw[:need], kind).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        page[y : y + rows, x : x + bw] = block[: h - y, : w - x]
    return {"width": w, "height": h, "samples": samples, "bits": bits, "compression": compression, "pixels": page.astype(kind.newbyteorder("<")).tobytes()}


def read_tiff(data: bytes, most: int | None = None) -> Iterator[dict]:
    """Pages in file order. A page that cannot be read has only ``error``, and so has a fault of the directories, which ends the file."""

    def failed(number: int, e: TiffError) -> dict:
        return {"page": number, "width": None, "height": None, "samples": None, "bits": None, "compression": None, "pixels": None, "error": str(e)}

    number = 0
    try:
        for order, fields in directories(data):
            try:
                page = {"page": number, **(read_page(data, order, fields) if most is None else read_page(data, order, fields, most)), "error": None}
            except TiffError as e:
                page = failed(number, e)
            yield page
            number += 1
    except TiffError as e:
        yield failed(number, e)


def tiff_pages(df: DataFrame, media: str = "media", fold: Callable[[bytes, Iterator[dict]], dict] | None = None, fold_schema: str = "", keep: list[str] | None = None, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per page of the files in column ``media``: the columns ``keep`` and those of PAGE_SCHEMA.

    Pixels are the samples of a page row by row, little-endian. A null file has
    no pages and no row; a page that is broken or not supported has a row with
    ``error``, and the pages after it are read, and so has a page of more than
    ``page_bytes`` bytes of samples, as a row cannot hold any number of them
    (Spark's limit is 2 ** 31); strips whose bits are in reverse order (tag 266)
    are turned round before they are decoded; an empty file or one whose
    directories are broken has such a row where the fault is. With ``fold``, a
    function of the file and its pages, each file that is not null gives the one
    row the function makes of its pages, so that pages need not be shuffled to
    meet again. Rows are independent of each other, repeated ones too; a file is
    held in memory with one page at a time. ``keep`` must not hold the names of
    the columns returned; an empty table gives no rows.
    """
    keep = keep or []
    fields = [x.split() for x in (fold_schema if fold else PAGE_SCHEMA).split(", ")]
    names, types = [x[0] for x in fields], [arrow_type(x[1]) for x in fields]
    if set(keep) & set(names):
        raise ValueError(f"names that are returned cannot be kept: {sorted(set(keep) & set(names))}")
    n, kept = len(keep), [f"_{i}" for i in range(len(keep))]
    picked = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(media).alias("media"))
    schema = "".join(f"`{k}` {picked.schema[k].dataType.simpleString()}, " for k in kept) + (fold_schema if fold else PAGE_SCHEMA)

    def told(file: bytes) -> Iterator[dict]:
        return iter([fold(file, read_tiff(file, page_bytes))]) if fold else read_tiff(file, page_bytes)

    def rows(batch: pa.RecordBatch, at: list[int], made: list[dict]) -> pa.RecordBatch:
        left = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(n)]
        return pa.RecordBatch.from_arrays(left + [pa.array([p[x] for p in made], t) for x, t in zip(names, types)], names=kept + names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media"):
            made, at, size = [], [], 0
            for i, file in enumerate(batch.column(n)):
                for page in told(data) if (data := file.as_py()) is not None else ():
                    made.append(page)
                    at.append(i)
                    size += len(page.get("pixels") or b"")
                    if size > STEP_BYTES:
                        yield rows(batch, at, made)
                        made, at, size = [], [], 0
            if made:
                yield rows(batch, at, made)

    return picked.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], *names)


def arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[kind]


#: A payload's unit of bytes, the side of the first page, and the most rows of the others.
UNIT, SIDE, ROWS = 576, 24, 64


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up with bytes 255 to a positive multiple of UNIT."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def payload_tiff(data: bytes) -> bytes:
    """A payload as pages: the first SIDE x SIDE in LZW strips, then pages of UNIT columns: deflate tiles, PackBits strips, deflate tiles and one LZW strip by turns."""
    samples = np.frombuffer(data, np.uint8)
    pages = [{"pixels": samples[:UNIT].reshape(SIDE, SIDE), "compression": LZW, "predictor": 2, "rows": 8}]
    for k, start in enumerate(range(UNIT, len(samples), UNIT * ROWS)):
        pixels = samples[start : start + UNIT * ROWS].reshape(-1, UNIT)
        if k % 2 == 0:
            pages.append({"pixels": pixels, "compression": DEFLATE, "predictor": 2, "tile": (192, 16)})
        else:
            pages.append({"pixels": pixels, "compression": PACKBITS, "rows": 16} if k % 4 == 1 else {"pixels": pixels, "compression": LZW, "rows": ROWS})
    return write_tiff(pages)


def texts_to_tiff(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a TIFF file of its payload; rows are independent of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            raw = [b"" if t is None else t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([payload_tiff(payload(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


DIGEST_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(file: bytes, pages: Iterator[dict]) -> dict:
    """What the pages of a file say of the payload stored in it."""
    whole, tail, size, n_pages = hashlib.sha256(), b"", 0, 0
    counts = np.zeros(256, np.int64)
    for page in pages:
        if page["error"]:
            raise TiffError(page["error"])
        pixels = page["pixels"]
        whole.update(pixels)
        tail, size, n_pages = (tail + pixels)[-32:], size + len(pixels), n_pages + 1
        counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    mean = float(counts @ np.arange(256)) / max(1, size)
    share = counts[counts > 0] / max(1, size)
    feature = f"pages={n_pages};mean={mean:.4f};values={int((counts > 0).sum())};entropy={float(-(share * np.log2(share)).sum()):.4f}"
    return {"payload_bytes": size, "payload_sha256": whole.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": feature}


def op7_tiff_pages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tiff_pages(texts_to_tiff(docs), fold=digest, fold_schema=DIGEST_SCHEMA, keep=["doc_id", "n_bytes"])
