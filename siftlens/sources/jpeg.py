"""JPEG files: their segments, with the fields of each."""

import re
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlens.sources import exif
from siftlens.sources.files import decoded

# Marker names.
NAMES = {0x01: "TEM", 0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM"}
NAMES |= {0xC0 + n: f"SOF{n}" for n in range(16) if n not in (4, 8, 12)}
NAMES |= {0xD0 + n: f"RST{n}" for n in range(8)} | {0xE0 + n: f"APP{n}" for n in range(16)} | {0xF0 + n: f"JPG{n}" for n in range(14)}

# Labels.
PROCESSES = {0: "Baseline DCT", 1: "Extended sequential DCT", 2: "Progressive DCT", 3: "Lossless (sequential)", 5: "Differential sequential DCT", 6: "Differential progressive DCT", 7: "Differential lossless", 9: "Extended sequential DCT, arithmetic", 10: "Progressive DCT, arithmetic", 11: "Lossless, arithmetic"}
DENSITY = {0: "aspect ratio", 1: "dots per inch", 2: "dots per cm"}
ADOBE = {0: "CMYK", 1: "YCbCr", 2: "YCCK"}
THUMBNAIL = {0x10: "JPEG", 0x11: "1 byte per pixel", 0x13: "3 bytes per pixel"}


def _frame(marker: int, b: bytes) -> dict:
    precision, height, width, n = struct.unpack_from(">BHHB", b)
    parts = [{"id": b[6 + 3 * k], "h": b[7 + 3 * k] >> 4, "v": b[7 + 3 * k] & 15, "table": b[8 + 3 * k]} for k in range(n)]
    out = {"precision": precision, "height": height, "width": width, "components": parts}
    if marker in range(0xC0, 0xD0):
        out["process"] = PROCESSES.get(marker - 0xC0)
    if parts and all(p["h"] and p["v"] for p in parts):
        most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
        out |= {"blocks_across": -(-width // (8 * most_h)), "blocks_down": -(-height // (8 * most_v))}
    return out


def _huffman(b: bytes) -> dict:
    tables, at = [], 0
    while at + 17 <= len(b):
        counts = list(b[at + 1 : at + 17])
        code, codes, place = 0, [], at + 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes.append({"symbol": b[place], "length": length, "code": format(code, f"0{length}b")})
                code, place = code + 1, place + 1
            code <<= 1
        tables.append({"class": b[at] >> 4, "index": b[at] & 15, "symbols": sum(counts), "codes": codes})
        at = place
    return {"tables": tables}


def _quantisation(b: bytes) -> dict:
    tables, at = [], 0
    while at < len(b):
        wide = b[at] >> 4
        size = 128 if wide else 64
        tables.append({"index": b[at] & 15, "precision": 16 if wide else 8, "elements": list(struct.unpack_from(">64H" if wide else "64B", b, at + 1))})
        at += 1 + size
    return {"tables": tables}


def _scan(b: bytes) -> dict:
    n = b[0]
    parts = [{"component": b[1 + 2 * k], "dc": b[2 + 2 * k] >> 4, "ac": b[2 + 2 * k] & 15} for k in range(n)]
    first, last, near = b[1 + 2 * n : 4 + 2 * n]
    return {"components": parts, "spectral_start": first, "spectral_end": last, "successive_previous": near >> 4, "successive": near & 15}


def _application(n: int, b: bytes) -> dict:
    if n == 0 and b.startswith(b"JFIF\0"):
        major, minor, unit, x, y, wide, high = struct.unpack_from(">BBBHHBB", b, 5)
        return {"identifier": "JFIF", "version": f"{major}.{minor:02d}", "unit": unit, "unit_label": DENSITY.get(unit), "x_density": x, "y_density": y, "thumbnail_width": wide, "thumbnail_height": high}
    if n == 0 and b.startswith(b"JFXX\0"):
        out = {"identifier": "JFXX", "extension": b[5], "extension_label": THUMBNAIL.get(b[5])}
        return out | ({"thumbnail_width": b[6], "thumbnail_height": b[7]} if b[5] in (0x11, 0x13) else {"thumbnail_size": len(b) - 6})
    if n == 0 and b.startswith(b"AVI1"):
        return {"identifier": "AVI1", "interleaved": b[4], "interleaved_label": {0: "not interleaved", 1: "odd field", 2: "even field"}.get(b[4])}
    if b.startswith(b"Ocad"):
        found = re.search(rb"\$(\w+):([^\0$]+)", b)
        return {"identifier": "Ocad", "revision": found[2].decode("latin-1").strip() if found else None}
    if n == 1 and b.startswith(b"Exif\0\0"):
        return {"identifier": "Exif", "entries": list(exif.entries(b[6:]))}
    if n == 14 and b.startswith(b"Adobe"):
        version, flags0, flags1, transform = struct.unpack_from(">HHHB", b, 5)
        return {"identifier": "Adobe", "version": version, "flags0": flags0, "flags1": flags1, "transform": transform, "transform_label": ADOBE.get(transform)}
    name = b.split(b"\0")[0][:32]
    return {"identifier": name.decode("latin-1") if name.isalnum() else None, "bytes": len(b)}


def _fields(marker: int, b: bytes) -> dict:
    if marker in (0xDE,) or NAMES.get(marker, "").startswith("SOF"):
        return _frame(marker, b)
    if 0xE0 <= marker <= 0xEF:
        return _application(marker - 0xE0, b)
    return {
        0xC4: _huffman, 0xDB: _quantisation, 0xDA: _scan,
        0xCC: lambda b: {"tables": [{"class": b[k] >> 4, "index": b[k] & 15, "value": b[k + 1]} for k in range(0, len(b) - 1, 2)]},
        0xDC: lambda b: {"lines": struct.unpack(">H", b[:2])[0]}, 0xDD: lambda b: {"restart_interval": struct.unpack(">H", b[:2])[0]},
        0xDF: lambda b: {"horizontal": b[0] >> 4, "vertical": b[0] & 15}, 0xFE: lambda b: {"comment": b.decode("utf-8", "replace")},
    }.get(marker, lambda b: {"bytes": len(b)})(b)


def segments(data: bytes) -> Iterator[dict]:
    """Segments up to the end marker, the end of the bytes, or the first thing that is no marker."""
    at = 0
    while at + 1 < len(data):
        if data[at] != 0xFF:
            yield {"offset": at, "code": data[at], "name": None, "size": 0, "error": "no marker"}
            return
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker = data[at + 1] if at + 1 < len(data) else 0
        row = {"offset": at, "code": marker, "name": NAMES.get(marker, f"0x{marker:02X}"), "size": 2}
        at += 2
        if marker in (0x01, 0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            yield row
            if marker == 0xD9:
                return
            continue
        if at + 2 > len(data) or (size := struct.unpack_from(">H", data, at)[0]) < 2 or at + size > len(data):
            yield row | {"error": "segment is cut off"}
            return
        body, row["size"] = data[at + 2 : at + size], size + 2
        at += size
        try:
            row["fields"] = _fields(marker, body)
        except (IndexError, struct.error) as e:
            row["error"] = f"segment is malformed: {e}"
        if marker == 0xDA:  # coded data run up to the next marker that is neither a stuffed byte nor a restart
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            row["fields"] = row.get("fields", {}) | {"coded_bytes": end - at}
            at = end
        yield row


def jpeg_segments(files: DataFrame) -> DataFrame:
    """One row a segment of each file (path, content); `fields` is JSON text."""
    return decoded(files, segments)


_ENTRY = "struct<ifd:string,tag_id:int,tag:string,type:string,count:bigint,num:array<bigint>,den:array<bigint>,value:array<double>,text:string,hex:string,label:string,error:string>"


def exif_tags(files: DataFrame) -> DataFrame:
    """One row an Exif entry. Where directories share a tag, all its rows are kept, in the order of directories."""
    apps = jpeg_segments(files).where(F.col("name") == "APP1")
    found = F.from_json("fields", f"struct<entries:array<{_ENTRY}>>")["entries"]
    return apps.select("path", F.posexplode(found).alias("place", "entry")).select("path", "place", "entry.*")


def merged_tags(entries: DataFrame) -> DataFrame:
    """One row a file and tag: a later directory's value replaces an earlier one's."""
    keep = [c for c in entries.columns if c not in ("path", "tag", "place")]
    best = entries.where("tag is not null").groupBy("path", "tag").agg(F.max_by(F.struct(*keep), "place").alias("last"))
    return best.select("path", "tag", *[F.col(f"last.{c}").alias(c) for c in keep])


def sniffed(content: Column) -> Column:
    """What kind of embedded file the bytes begin as; the first that fits counts."""
    start = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 50), "ISO-8859-1")
    return (
        F.when(start.startswith("A5"), "PBJ").when(start.startswith("474946383761") | start.startswith("474946383961"), "GIF")
        .when(start.startswith("465753") | start.startswith("435753"), "SWF").when(text.rlike("(?s)<.*>"), "XML")
        .when(start.startswith("FFD8"), "JPEG").when(start.startswith("89504E470D0A1A0A"), "PNG")
    )
