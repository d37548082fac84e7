"""TIFF as a media column: lossless storage of bytes as 8-bit samples, and a reader that emits one row for each page.

The reader walks the chain of image directories (either byte order), decodes strips or tiles (stored, PackBits, LZW
or deflate; either fill order), undoes the horizontal or the floating-point predictor, unpacks samples of 1, 2 and 4 bits, and puts planes together. It works
page by page. Samples of floating point come out as the unsigned integers of their bits.

Payloads are stored in several forms, which their checksum chooses: deflated strips, deflated tiles, LZW or PackBits.

Defined results: a null text is an empty one, stored as 64 zero bytes; a null or malformed file gives one row with
``error`` set, without pixels or payload; so does a page or tile of more than MAX_PAGE_BYTES, as one cell of a row has to hold it, and a form of
compression that isn't named here; long texts go to several pages of bounded size; equal texts give equal rows and repeated rows
repeat; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, map_batches, ship_package, table

# Fixed values of the format (TIFF 6.0 and its Adobe supplement).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 266, 284, 317, 322, 323, 324, 325
STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW_BYTES = 64
STRIP_ROWS = 1024
PAGE_ROWS = 1 << 16
MAX_PAGE_BYTES = 1 << 30


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader takes."""


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends; a width grows one code early."""
    out, acc, held, width = bytearray(), 0, 0, 9
    table = {bytes((i,)): i for i in range(256)}
    free, prefix = 258, b""

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(256)
    for byte in data:
        longer = prefix + bytes((byte,))
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = free
        free += 1
        if free == 4095:
            put(256)
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free + 1 > 1 << width:
            width += 1
        prefix = bytes((byte,))
    if prefix:
        put(table[prefix])
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, acc, held, width = bytearray(), 0, 0, 9
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last = list(singles), b""
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW: the code after a clear is not a byte")
            entry = singles[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW: a code that is not yet in the table")
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


COMPRESS = {STORED: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), OLD_DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits_encode}
#: Each byte with its bits in reverse.
MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
EXPAND = {STORED: lambda d, n: bytes(d[:n]), LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}


def split_bytes(block: np.ndarray) -> np.ndarray:
    """The floating-point predictor: of each row the bytes of all samples by significance, highest first, each less the one a pixel before."""
    rows, width, samples = block.shape
    size = block.dtype.itemsize
    planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, width * samples, size).transpose(0, 2, 1).reshape(rows, -1, samples)
    return np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)


def join_bytes(raw: np.ndarray, rows: int, width: int, samples: int, kind: np.dtype) -> np.ndarray:
    planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).astype(kind).reshape(rows, width, samples)


def pack_bits(block: np.ndarray, bits: int) -> bytes:
    """Samples of fewer than 8 bits, rows filled up to whole bytes."""
    flat = np.unpackbits(block.reshape(len(block), -1, 1), axis=2)[:, :, 8 - bits :]
    return np.packbits(flat.reshape(len(block), -1), axis=1).tobytes()


def unpack_bits(raw: bytes, rows: int, width: int, samples: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * samples * bits].reshape(rows, width * samples, bits)
    return np.packbits(flat, axis=2)[:, :, 0].reshape(rows, width, samples) >> (8 - bits)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, big_endian: bool = False, planar: int = 1, bits: int | None = None, fill_order: int = 1) -> bytes:
    """A file of the pages: arrays of unsigned integers, rows x columns or rows x columns x samples. tile: (rows, columns), multiples of 16; bits: 1, 2 or 4 for packed samples."""
    depth = bits
    e = ">" if big_endian else "<"
    out, link = bytearray((b"MM" if big_endian else b"II") + struct.pack(e + "HI", 42, 0)), 4
    for page in pages:
        image = page if page.ndim == 3 else page[:, :, None]
        h, w, s = image.shape
        bits = depth or image.dtype.itemsize * 8
        planes = [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(s)]
        at, sizes = [], []
        for plane in planes:
            th, tw = tile or (strip_rows, w)
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = plane[y : y + th, x : x + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                    elif predictor == 3:
                        block = split_bytes(block)
                    packed = COMPRESS[compression](pack_bits(block, bits) if bits < 8 else block.astype(block.dtype.newbyteorder(e)).tobytes())
                    if fill_order == 2:
                        packed = packed.translate(MIRRORED)
                    out += b"\0" * (len(out) % 2)
                    at.append(len(out))
                    sizes.append(len(packed))
                    out += packed
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if s == 3 else 1]), (SAMPLES, 3, [s]), (PLANAR, 3, [planar]), (PREDICTOR, 3, [predictor]), (FILL_ORDER, 3, [fill_order])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, at), (TILE_COUNTS, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, sizes)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{e}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place, raw_at = struct.pack(e + "I", len(out)), raw
                out += raw_at
            else:
                place = raw.ljust(4, b"\0")
            entries += struct.pack(e + "HHI", tag, kind, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into(e + "I", out, link, len(out))
        out += struct.pack(e + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def _directory(data: bytes, at: int, e: str) -> tuple[dict[int, list[int]], int]:
    """The tags of the directory at an offset, and where the next one is."""
    (n,) = struct.unpack_from(e + "H", data, at)
    tags: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        where = at + 10 + 12 * i
        if TYPE_SIZE[kind] * count > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        if where + TYPE_SIZE[kind] * count > len(data):
            raise TiffError(f"tag {tag} lies beyond the file")
        tags[tag] = list(struct.unpack_from(f"{e}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where))
    (following,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)
    return tags, following


def _read_page(data: bytes, tags: dict[int, list[int]], e: str, index: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not w or not h or bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, [bits]))) > 1:
        raise TiffError(f"a page of {w} x {h} with {tags.get(BITS)} bits is not taken")
    if compression not in EXPAND or predictor not in ((1,) if bits < 8 else (1, 2, 3)):
        raise TiffError(f"compression {compression} with predictor {predictor} is not taken")
    kind = np.dtype(f"u{max(bits, 8) // 8}")
    if w * h * s * kind.itemsize > MAX_PAGE_BYTES:
        raise TiffError("the page is too large")
    tiled = TILE_OFFSETS in tags
    th, tw = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    at, sizes = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    down, across, depth, planes = math.ceil(h / max(th or 0, 1)), math.ceil(w / max(tw or 0, 1)), s if planar == 1 else 1, 1 if planar == 1 else s
    if not th or not tw or not at or not sizes or min(len(at), len(sizes)) < down * across * planes:
        raise TiffError("strips or tiles are missing")
    if th * tw * depth * kind.itemsize > MAX_PAGE_BYTES:
        raise TiffError("a tile is too large")
    pixels = np.zeros((h, w, s), kind)
    for k in range(down * across * planes):
        plane, cell = divmod(k, down * across)
        y, x = cell // across * th, cell % across * tw
        rows = th if tiled else min(th, h - y)
        size = rows * (-(-tw * depth * bits // 8))
        packed = data[at[k] : at[k] + sizes[k]]
        raw = EXPAND[compression](packed.translate(MIRRORED) if one(FILL_ORDER, 1) == 2 else packed, size)
        if len(raw) < size:
            raise TiffError(f"strip or tile {k} is short")
        if bits < 8:
            block = unpack_bits(raw[:size], rows, tw, depth, bits)
        elif predictor == 3:
            block = join_bytes(np.frombuffer(raw[:size], np.uint8), rows, tw, depth, kind)
        else:
            block = np.frombuffer(raw[:size], kind.newbyteorder(e)).astype(kind).reshape(rows, tw, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        put = block[: h - y, : w - x]
        if planar == 1:
            pixels[y : y + put.shape[0], x : x + put.shape[1]] = put
        else:
            pixels[y : y + put.shape[0], x : x + put.shape[1], plane] = put[:, :, 0]
    return Page(index, w, h, s, bits, compression, predictor, tiled, pixels)


def iter_pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directory chain. Raises TiffError on a malformed file, a loop in the chain included."""
    e = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if e is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic, at = struct.unpack_from(e + "HI", data, 2)
    if magic != 42:
        raise TiffError(f"magic {magic}")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories loop")
        seen.add(at)
        try:
            tags, following = _directory(data, at, e)
        except struct.error as x:
            raise TiffError("a directory lies beyond the file") from x
        yield _read_page(data, tags, e, len(seen) - 1)
        at = following


#: Of FORM_SHARE payloads, by checksum, one goes to each of these; the others are deflated strips. LZW and PackBits run in Python here, so their share is small.
FORMS = ({"compression": LZW}, {"compression": PACKBITS}, {"compression": DEFLATE, "predictor": 2, "tile": (64, 32)}, {"compression": DEFLATE, "predictor": 2, "big_endian": True})
FORM_SHARE = 16


def store_payload(payload: bytes) -> bytes:
    """Bytes, a multiple of ROW_BYTES of them, as pages of ROW_BYTES columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    choice = zlib.crc32(payload) % FORM_SHARE
    form = FORMS[choice] if choice < len(FORMS) else {"compression": DEFLATE, "predictor": 2}
    return write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], **form)


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % ROW_BYTES or (0 if raw else ROW_BYTES))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded, as a TIFF."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [(v.as_py() or "").encode() for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([store_payload(pad(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(keyed_texts(docs), work, "doc_id long, n_bytes long, media binary")


PAGE_SCHEMA = "key long, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def decode_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each page of the TIFFs of a binary column; rows of a file that breaks off end with one that has ``error``."""
    ship_package(media.sparkSession)
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def emit(batches):
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1), strict=True):
                i = -1
                try:
                    for p in iter_pages(v.as_py() or b""):
                        i = p.index
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (k.as_py(), i, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), None), strict=True))], page_schema)
                except TiffError as e:
                    yield pa.RecordBatch.from_pylist([{"key": k.as_py(), "page": i + 1, "error": str(e)}], page_schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    page_schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, PAGE_SCHEMA.split(", "), strict=True)])
    return media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")).mapInArrow(emit, PAGE_SCHEMA)


def features(counts: np.ndarray, pages: int, rows: int) -> str:
    """Pages, rows, mean, distinct samples and entropy in bits of a histogram of samples."""
    n = max(int(counts.sum()), 1)
    share = counts[counts > 0] / n
    mean = float((counts * np.arange(256)).sum()) / n
    return f"pages={pages};rows={rows};mean={mean:.6f};distinct={len(share)};entropy={abs(float(-(share * np.log2(share)).sum())):.6f}"


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored files back page by page; a digest row for each: payload, media and features of the samples; where a file can't be read, ``error`` in their place."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, n, v in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            data = v.as_py()
            sha, size, pages, height, tail, counts = hashlib.sha256(), 0, 0, 0, b"", np.zeros(256, np.int64)
            try:
                for p in iter_pages(data or b""):
                    raw = p.pixels.tobytes()
                    sha.update(raw)
                    size, pages, height, tail = size + len(raw), pages + 1, height + p.height, (tail + raw[-ROW_BYTES:])[-ROW_BYTES:]
                    counts += np.bincount(p.pixels.view(np.uint8).ravel(), minlength=256)
                read = (size, sha.hexdigest(), zlib.crc32(tail)) if pages else (0, sha.hexdigest(), 0)
                seen, error = features(counts, pages, height), None
            except TiffError as e:
                read, seen, error = (None, None, None), None, str(e)
            stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            rows.append((k, n, *read, *stored, seen, error))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(media, work, schema)


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(encode_media(table(spark, sf_dir, "documents")))


QUERIES = {"op7_tiff_media": op7_tiff_media}
ORACLES: dict[str, str] = {}
