"""Headers of photos: TIFF directories (also those in a JPEG's EXIF), XMP packets, pixels of plain TIFFs.

Everything is parsed from bytes; nothing is decoded that a header does not need.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Bytes of a file in which an XMP packet is looked for.
XMP_REACH = 512 * 1024
# Sizes and struct codes of TIFF field types.
FIELD_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
# Tags by name.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "predictor": 317,
    "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325, "sample_format": 339, "make": 271, "model": 272, "xmp": 700, "exif": 34665, "gps": 34853, "black_level": 50714,
    "exposure": 33434, "iso": 34855, "iso_speed": 34867, "datetime": 36867, "focal": 37386, "plane_x": 41486, "plane_y": 41487, "plane_unit": 41488, "focal_35mm": 41989,
}


def directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """Tags of the directory at a place: numbers, texts, or tuples of numbers (rationals divided, None over zero)."""
    out = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
        if kind not in FIELD_TYPES:
            continue
        size, code = FIELD_TYPES[kind]
        place = at + 2 + 12 * i + 8
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * count > len(data):
            continue
        if code == "s":
            raw = data[place : place + count]
            out[tag] = raw.decode("utf-8", "replace").strip("\0 ") if kind == 2 else raw
            continue
        values = struct.unpack_from(order + code[0] * (count * len(code)), data, place)
        if len(code) == 2:
            values = tuple(a / b if b else None for a, b in zip(values[::2], values[1::2]))
        out[tag] = values[0] if count == 1 else values
    return out


def tiff_tags(data: bytes) -> tuple[dict[int, object], str]:
    """First directory of a TIFF stream, and its byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF stream")
    return directory(data, struct.unpack_from(order + "I", data, 4)[0], order), order


def jpeg_header(data: bytes) -> tuple[int, int, bytes | None]:
    """Width, height and EXIF stream of a JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, exif = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG header")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and exif is None:
            exif = data[at + 10 : at + 2 + size]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, exif
        at += 2 + size
    raise ValueError("a JPEG without a frame")


def number(value) -> float | None:
    """A number, of a tuple its first; None where it is none."""
    if isinstance(value, tuple):
        value = value[0] if value else None
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def numbers(value) -> list[float] | None:
    """All numbers of a list or of a text parted by commas or spaces; None unless each is one."""
    if value is None:
        return None
    parts = value if isinstance(value, (list, tuple)) else re.split(r"[,\s]+", str(value).strip())
    out = [number(p) for p in parts]
    return None if not out or None in out else out


def degrees(parts, reference) -> float | None:
    if not isinstance(parts, tuple) or len(parts) < 3 or None in parts[:3]:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if str(reference or "").strip().upper() in ("S", "W") else value


def xmp_packet(head: bytes) -> str:
    m = re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", head[:XMP_REACH], re.S)
    return m[0].decode("utf-8", "ignore") if m else ""


def xmp_values(packet: str) -> dict[str, object]:
    """prefix:name to text of a packet's attributes and elements (elements win); sequences are lists."""
    out: dict[str, object] = dict(re.findall(r'([\w-]+:[\w-]+)="([^"]*)"', packet))
    out.update((k, v) for k, v in re.findall(r"<([\w-]+:[\w-]+)>([^<]*)</\1>", packet) if k != "rdf:li")
    for name, body in re.findall(r"<([\w-]+:[\w-]+)>\s*<rdf:(?:Seq|Bag)>(.*?)</rdf:(?:Seq|Bag)>", packet, re.S):
        out[name] = re.findall(r"<rdf:li[^>]*>([^<]*)</rdf:li>", body)
    return out


def tiff_pixels(data: bytes) -> np.ndarray:
    """Samples of a TIFF in strips or tiles, uncompressed or deflated, horizontal predictor allowed: (rows, columns[, samples])."""
    t, order = tiff_tags(data)
    get = lambda k, d=None: t.get(TAGS[k], d)
    many = lambda v: v if isinstance(v, tuple) else (v,)
    width, height, samples = int(get("width")), int(get("height")), int(get("samples", 1))
    bits, form, packing = int(many(get("bits", 8))[0]), int(many(get("sample_format", 1))[0]), int(get("compression", 1))
    if packing not in (1, 8, 32946) or int(get("planar", 1)) != 1:
        raise ValueError("only uncompressed or deflated chunky TIFFs are read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    tiled = TAGS["tile_offsets"] in t
    tw, th = (int(get("tile_width")), int(get("tile_height"))) if tiled else (width, int(get("rows_per_strip", height)))
    across = -(-width // tw)
    for i, (at, size) in enumerate(zip(many(get("tile_offsets" if tiled else "strip_offsets")), many(get("tile_bytes" if tiled else "strip_bytes")))):
        raw = data[at : at + size]
        raw = raw if packing == 1 else zlib.decompress(raw)
        r, c = i // across * th, i % across * tw
        rows = th if tiled else min(th, height - r)
        block = np.frombuffer(raw, kind, rows * tw * samples).reshape(rows, tw, samples)
        if int(get("predictor", 1)) == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        out[r : r + rows, c : c + tw] = block[: height - r, : width - c]
    return out[:, :, 0] if samples == 1 else out


def tiff_bytes(pixels: np.ndarray, west: float | None = None, north: float | None = None, cell: float | None = None, epsg: int | None = None) -> bytes:
    """A deflated one-strip TIFF of (rows, columns[, samples]); with a north-up georeference if given."""
    pixels = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None])
    rows, cols, samples = pixels.shape
    form = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    body = zlib.compress(pixels.astype(pixels.dtype.newbyteorder("<")).tobytes())
    n = pixels.dtype.itemsize * 8
    fields = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [n] * samples), (259, 3, [8]), (262, 3, [1 if samples < 3 else 2]), (273, 4, [8]), (277, 3, [samples]), (278, 4, [rows]), (279, 4, [len(body)]), (284, 3, [1]), (339, 3, [form] * samples)]
    if cell is not None:
        fields += [(33550, 12, [cell, cell, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
        if epsg is not None:
            geographic = epsg == 4326
            fields += [(34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])]
    fields.sort()
    at = 8 + len(body) + len(body) % 2
    extra, entries, over = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack("<" + FIELD_TYPES[kind][1] * len(values), *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), over + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra
