"""Vector-animation files: header, tags with their fields, frames, the character dictionary."""

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlens.sources.files import MOST_UNPACKED, decoded

# Tag names by code, from 0; codes that no public text names are UNKNOWN.
NAMES = dict(enumerate((
    "End ShowFrame DefineShape FreeCharacter PlaceObject RemoveObject DefineBits DefineButton JPEGTables SetBackgroundColor DefineFont DefineText DoAction DefineFontInfo DefineSound StartSound StopSound "
    "DefineButtonSound SoundStreamHead SoundStreamBlock DefineBitsLossless DefineBitsJPEG2 DefineShape2 DefineButtonCxform Protect PathsArePostscript PlaceObject2 UNKNOWN RemoveObject2 SyncFrame UNKNOWN "
    "FreeAll DefineShape3 DefineText2 DefineButton2 DefineBitsJPEG3 DefineBitsLossless2 DefineEditText DefineVideo DefineSprite NameCharacter ProductInfo DefineTextFormat FrameLabel DefineBehavior "
    "SoundStreamHead2 DefineMorphShape FrameTag DefineFont2 GenCommand DefineCommandObject CharacterSet FontRef DefineFunction PlaceFunction GenTagObject ExportAssets ImportAssets EnableDebugger "
    "DoInitAction DefineVideoStream VideoFrame DefineFontInfo2 DebugID EnableDebugger2 ScriptLimits SetTabIndex DefineShape4_ DefineMorphShape2_ FileAttributes PlaceObject3 ImportAssets2 DoABC "
    "DefineFontAlignZones CSMTextSettings DefineFont3 SymbolClass Metadata DefineScalingGrid UNKNOWN UNKNOWN UNKNOWN DoABC2 DefineShape4 DefineMorphShape2 UNKNOWN DefineSceneAndFrameLabelData "
    "DefineBinaryData DefineFontName StartSound2 DefineBitsJPEG4 DefineFont4"
).split()))
#: Tags whose first two bytes are the id of the character they define.
DEFINING = {2, 6, 7, 10, 11, 14, 20, 21, 22, 32, 33, 34, 35, 36, 37, 39, 46, 48, 60, 75, 78, 83, 84, 87, 90, 91}
SOUND_RATES, SOUND_FORMATS = (5512, 11025, 22050, 44100), ("uncompressed", "ADPCM", "MP3", "uncompressed little-endian", "Nellymoser 16 kHz", "Nellymoser 8 kHz", "Nellymoser", "", "", "", "", "Speex")


class Bits:
    """Reads bits, bytes and strings in order."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.bit = data, at, 0

    def align(self) -> None:
        if self.bit:
            self.at, self.bit = self.at + 1, 0

    def ub(self, n: int) -> int:
        end = self.bit + n
        size = -(-end // 8)
        chunk = self.data[self.at : self.at + size]
        if len(chunk) < size:
            raise EOFError("bits beyond the end")
        value = int.from_bytes(chunk, "big") >> (8 * size - end) & (1 << n) - 1
        self.at, self.bit = self.at + end // 8, end % 8
        return value

    def sb(self, n: int) -> int:
        value = self.ub(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def get(self, code: str) -> int:
        self.align()
        size = struct.calcsize("<" + code)
        if self.at + size > len(self.data):
            raise EOFError("bytes beyond the end")
        (value,) = struct.unpack_from("<" + code, self.data, self.at)
        self.at += size
        return value

    def text(self) -> str:
        self.align()
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        value, self.at = self.data[self.at : end].decode("utf-8", "replace"), end + 1
        return value

    def varint(self) -> int:
        value = 0
        for k in range(5):
            byte = self.get("B")
            value |= (byte & 127) << 7 * k
            if byte < 128:
                break
        return value

    def rectangle(self) -> dict:
        self.align()
        n = self.ub(5)
        out = {k: self.sb(n) / 20 for k in ("xmin", "xmax", "ymin", "ymax")}
        self.align()
        return out

    def matrix(self) -> dict:
        self.align()
        out = {"scale_x": 1.0, "scale_y": 1.0, "skew0": 0.0, "skew1": 0.0}
        for pair in (("scale_x", "scale_y"), ("skew0", "skew1")):
            if self.ub(1):
                n = self.ub(5)
                out |= {k: self.sb(n) / 65536 for k in pair}
        n = self.ub(5)
        out |= {"x": self.sb(n) / 20, "y": self.sb(n) / 20}
        self.align()
        return out

    def color(self, alpha: bool = False) -> str:
        return "#" + "".join(f"{self.get('B'):02x}" for _ in range(4 if alpha else 3))


def _assets(r: Bits) -> dict:
    n = r.get("H")
    return {"count": n, "assets": [{"id": r.get("H"), "name": r.text()} for _ in range(n)]}


def _place(r: Bits, third: bool) -> dict:
    flags = r.get("B")
    more = r.get("B") if third else 0
    out = {"move": flags & 1, "depth": r.get("H")}
    if more & 8 or (more & 16 and flags & 2):
        out["class_name"] = r.text()
    if flags & 2:
        out["character_id"] = r.get("H")
    if flags & 4:
        out["matrix"] = r.matrix()
    if flags & 8:
        r.align()
        add, mult, n = r.ub(1), r.ub(1), r.ub(4)
        out |= {"mult": [r.sb(n) / 256 for _ in range(4)]} if mult else {}
        out |= {"add": [r.sb(n) for _ in range(4)]} if add else {}
        r.align()
    if flags & 16:
        out["ratio"] = r.get("H")
    if flags & 32:
        out["name"] = r.text()
    if flags & 64:
        out["clip_depth"] = r.get("H")
    return out


def _sound(r: Bits) -> dict:
    kind, flags = r.get("H"), r.get("B")
    return {"id": kind, "format": SOUND_FORMATS[flags >> 4] if flags >> 4 < len(SOUND_FORMATS) else None, "rate": SOUND_RATES[flags >> 2 & 3], "bits": 16 if flags & 2 else 8, "channels": 1 + (flags & 1), "samples": r.get("I")}


def _stream(r: Bits) -> dict:
    play, flags = r.get("B"), r.get("B")
    return {"playback_rate": SOUND_RATES[play >> 2 & 3], "format": SOUND_FORMATS[flags >> 4] if flags >> 4 < len(SOUND_FORMATS) else None, "rate": SOUND_RATES[flags >> 2 & 3], "channels": 1 + (flags & 1), "samples": r.get("H")}


def _video(r: Bits) -> dict:
    out = {"id": r.get("H"), "frames": r.get("H"), "width": r.get("H"), "height": r.get("H")}
    flags = r.get("B")
    return out | {"deblocking": flags >> 1 & 7, "smoothing": flags & 1, "codec": r.get("B")}


def _font(r: Bits) -> dict:
    out, flags = {"id": r.get("H")}, r.get("B")
    language, n = r.get("B"), r.get("B")
    name = r.data[r.at : r.at + n].decode("utf-8", "replace").rstrip("\0")
    r.at += n
    return out | {"bold": flags & 1, "italic": flags >> 1 & 1, "layout": flags >> 7, "language": language, "font_name": name, "glyphs": r.get("H")}


def _scenes(r: Bits) -> dict:
    scenes = [{"offset": r.varint(), "name": r.text()} for _ in range(r.varint())]
    return {"scenes": scenes, "labels": [{"frame": r.varint(), "name": r.text()} for _ in range(r.varint())]}


def _product(r: Bits) -> dict:
    out = {"product": r.get("I"), "edition": r.get("I"), "major": r.get("B"), "minor": r.get("B")}
    return out | {"build": r.get("Q"), "compiled_ms": r.get("Q")}


_SHAPE = lambda r: {"id": r.get("H"), "bounds": r.rectangle()}
_IMAGE = lambda r: {"id": r.get("H"), "bytes": len(r.data) - r.at}
_ALPHA = lambda r: {"id": r.get("H"), "alpha_offset": r.get("I"), "bytes": len(r.data) - r.at}
_LOSSLESS = lambda r: {"id": r.get("H"), "format": r.get("B"), "width": r.get("H"), "height": r.get("H")}
_DECODERS = {
    2: _SHAPE, 22: _SHAPE, 32: _SHAPE, 83: _SHAPE, 46: _SHAPE, 84: _SHAPE, 6: _IMAGE, 21: _IMAGE, 35: _ALPHA, 90: _ALPHA, 20: _LOSSLESS, 36: _LOSSLESS,
    4: lambda r: {"character_id": r.get("H"), "depth": r.get("H"), "matrix": r.matrix()}, 26: lambda r: _place(r, False), 70: lambda r: _place(r, True),
    5: lambda r: {"character_id": r.get("H"), "depth": r.get("H")}, 28: lambda r: {"depth": r.get("H")}, 8: lambda r: {"bytes": len(r.data)}, 9: lambda r: {"color": r.color()},
    11: lambda r: _SHAPE(r) | {"matrix": r.matrix()}, 33: lambda r: _SHAPE(r) | {"matrix": r.matrix()}, 37: _SHAPE, 12: lambda r: {"bytes": len(r.data)}, 59: lambda r: {"sprite_id": r.get("H"), "bytes": len(r.data) - 2},
    13: lambda r: {"font_id": r.get("H"), "font_name": r.data[3 : 3 + r.get("B")].decode("utf-8", "replace")}, 14: _sound, 15: lambda r: {"id": r.get("H")}, 18: _stream, 45: _stream, 19: lambda r: {"bytes": len(r.data)},
    17: lambda r: {"button_id": r.get("H")}, 23: lambda r: {"button_id": r.get("H")}, 24: lambda r: {"password": r.text()}, 58: lambda r: {"password": r.text()}, 64: lambda r: {"reserved": r.get("H"), "password": r.text()},
    41: _product, 43: lambda r: {"label": r.text(), "anchor": r.get("B") if r.at < len(r.data) else 0}, 48: _font, 75: _font, 56: _assets, 76: _assets, 57: lambda r: {"url": r.text()} | _assets(r),
    71: lambda r: {"url": r.text(), "reserved": r.get("H")} | _assets(r), 60: _video, 61: lambda r: {"stream_id": r.get("H"), "frame": r.get("H"), "bytes": len(r.data) - 4},
    63: lambda r: {"uuid": str(uuid.UUID(bytes=r.data[:16]))}, 65: lambda r: {"max_recursion": r.get("H"), "timeout_s": r.get("H")}, 66: lambda r: {"depth": r.get("H"), "tab_index": r.get("H")},
    69: lambda r: {k: r.data[0] >> n & 1 for k, n in (("direct_blit", 6), ("gpu", 5), ("metadata", 4), ("actionscript3", 3), ("network", 0))}, 72: lambda r: {"flags": r.get("I"), "abc_name": r.text()},
    82: lambda r: {"flags": r.get("I"), "abc_name": r.text()}, 73: lambda r: {"font_id": r.get("H"), "table_hint": r.get("B") >> 6}, 74: lambda r: {"text_id": r.get("H"), "flash_type": r.ub(2), "grid_fit": r.ub(3), "rest": r.ub(3)},
    77: lambda r: {"metadata": r.text()}, 78: lambda r: {"id": r.get("H"), "splitter": r.rectangle()}, 86: _scenes, 87: lambda r: {"id": r.get("H"), "reserved": r.get("I"), "bytes": len(r.data) - r.at},
    88: lambda r: {"font_id": r.get("H"), "font_name": r.text(), "copyright": r.text()}, 89: lambda r: {"sound_class": r.text()}, 39: lambda r: {"id": r.get("H"), "frames": r.get("H")},
}


def _walk(body: bytes, at: int, base: int, parent: str) -> Iterator[dict]:
    n = 0
    while at + 2 <= len(body):
        begin, (head,) = at, struct.unpack_from("<H", body, at)
        code, size, at = head >> 6, head & 63, at + 2
        if size == 63:
            if at + 4 > len(body):
                yield {"parent_path": parent, "offset": base + begin, "code": code, "name": NAMES.get(code), "size": 0, "error": "tag is cut off"}
                return
            (size,), at = struct.unpack_from("<I", body, at), at + 4
        row = {"parent_path": parent, "offset": base + begin, "code": code, "name": NAMES.get(code), "size": size}
        data = body[at : at + size]
        if len(data) < size:
            yield row | {"error": "tag is cut off"}
            return
        try:
            row["fields"] = _DECODERS[code](Bits(data)) if code in _DECODERS else {}
        except (EOFError, IndexError, ValueError) as e:
            row["error"] = f"tag is malformed: {e}"
        yield row
        if code == 39 and len(data) >= 4:
            yield from _walk(data, 4, base + at, f"{parent}/{n}")
        at, n = at + size, n + 1
        if code == 0:
            return


def tags(data: bytes) -> Iterator[dict]:
    """The header as code -1, then all tags up to the end tag; a sprite's tags follow it, with its place as parent_path.
    After a tag whose fields can't be read, reading goes on behind its length."""
    if data[:3] not in (b"FWS", b"CWS") or len(data) < 8:
        yield {"offset": 0, "code": -1, "name": "Header", "size": len(data), "error": "no header"}
        return
    version, (length,) = data[3], struct.unpack_from("<I", data, 4)
    body = data[8:]
    if data[:1] == b"C":
        inflater = zlib.decompressobj()
        try:
            body = inflater.decompress(body, min(max(length - 8, 1), MOST_UNPACKED))  # no more than the head states
        except zlib.error as e:
            yield {"offset": 0, "code": -1, "name": "Header", "size": len(data), "error": f"body can't be inflated: {e}"}
            return
    try:
        r = Bits(body)
        frame = r.rectangle()
        rate, count = r.get("H") / 256, r.get("H")
    except EOFError:
        yield {"offset": 0, "code": -1, "name": "Header", "size": len(data), "error": "header is cut off"}
        return
    yield {"offset": 0, "code": -1, "name": "Header", "size": r.at + 8, "fields": {"signature": data[:3].decode(), "version": version, "file_length": length, **frame, "frame_rate": rate, "frame_count": count}}
    yield from _walk(body, r.at, 8, "")


def swf_tags(files: DataFrame) -> DataFrame:
    """One row a tag of each file (path, content); `fields` is JSON text."""
    return decoded(files, tags)


def swf_header(found: DataFrame) -> DataFrame:
    kinds = "struct<signature:string,version:int,file_length:bigint,xmin:double,xmax:double,ymin:double,ymax:double,frame_rate:double,frame_count:int>"
    return found.where("code = -1").select("path", F.from_json("fields", kinds).alias("h"), "error").select("path", "h.*", "error")


def swf_frames(found: DataFrame) -> DataFrame:
    """One row a frame of the main timeline: its number, label, tags placed or acting in it."""
    main = found.where("parent_path = '' and code >= 0")
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    main = main.withColumn("frame_no", F.coalesce(F.sum((F.col("code") == 1).cast("int")).over(before), F.lit(0)))
    shown = main.groupBy("path", "frame_no").agg(
        F.max(F.when(F.col("code") == 43, F.get_json_object("fields", "$.label"))).alias("label"),
        F.count_if(F.col("code") == 12).alias("actions"), F.count_if(F.col("code").isin(4, 26, 70)).alias("placed"), F.max((F.col("code") == 1).cast("int")).alias("ends"))
    return shown.where("ends = 1").drop("ends")


def swf_characters(found: DataFrame) -> DataFrame:
    """The dictionary: one row a character id, defined by the last tag that does; with the name that assets or symbols
    give it. Of several names in one tag the first counts, of several tags the last."""
    key = ["path", "id"]
    defined = found.where(F.col("code").isin(list(DEFINING))).withColumn("id", F.get_json_object("fields", "$.id").cast("int"))
    defined = defined.groupBy(*key).agg(F.max_by(F.struct("name", "fields"), "seq").alias("d"))
    assets = F.from_json(F.get_json_object("fields", "$.assets"), "array<struct<id:int,name:string>>")
    named = found.where(F.col("code").isin(56, 57, 71, 76)).select("path", "seq", F.posexplode(assets).alias("place", "a"))
    named = named.groupBy("path", F.col("a.id").alias("id")).agg(F.max_by("a.name", F.struct("seq", -F.col("place"))).alias("symbol"))
    return defined.join(named, key, "full").select(*key, F.col("d.name").alias("kind"), F.col("d.fields").alias("fields"), "symbol")
