"""Readers over files made byte by byte."""

import json
import struct
import zlib

import pytest

from siftlens.plans.files import image_of, movie_of
from siftlens.sources import exif, jpeg, overlays, swf, tracks


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def named(rows):
    return [r["name"] for r in rows]


def test_jpeg_up_to_the_end():
    rows = list(jpeg.segments(image_of("Maker", 9) + b"trailer"))
    assert named(rows) == ["SOI", "APP0", "APP1", "COM", "SOF0", "EOI"]
    assert rows[3]["fields"]["comment"] == "Maker"
    assert rows[4]["fields"] | {"components": None} == {"precision": 8, "height": 9, "width": 18, "components": None, "process": "Baseline DCT", "blocks_across": 3, "blocks_down": 2}


def test_jpeg_tables_and_scan():
    dht = bytes([0x10, 0, 2, 1] + [0] * 13 + [5, 6, 7])
    dqt = bytes([0x01, *range(64)])
    sos = bytes([1, 1, 0x12, 0, 63, 0])
    data = b"\xff\xd8" + segment(0xC4, dht) + segment(0xDB, dqt) + segment(0xDD, b"\0\x08") + segment(0xDA, sos) + b"\x01\xff\x00\x02\xff\xd0\x03" + b"\xff\xd9"
    rows = {r["name"]: r for r in jpeg.segments(data)}
    assert [(c["symbol"], c["code"]) for c in rows["DHT"]["fields"]["tables"][0]["codes"]] == [(5, "00"), (6, "01"), (7, "100")]
    assert rows["DQT"]["fields"]["tables"][0]["elements"][63] == 63
    assert rows["DRI"]["fields"] == {"restart_interval": 8}
    assert rows["SOS"]["fields"]["coded_bytes"] == 7 and rows["SOS"]["fields"]["components"][0] == {"component": 1, "dc": 1, "ac": 2}
    assert "EOI" in rows


@pytest.mark.parametrize("body, label", [(b"Adobe" + struct.pack(">HHHB", 100, 0, 0, 2), "YCCK"), (b"Adobe" + struct.pack(">HHHB", 100, 0, 0, 9), None)])
def test_jpeg_adobe(body, label):
    assert list(jpeg.segments(b"\xff\xd8" + segment(0xEE, body)))[1]["fields"]["transform_label"] == label


def test_jpeg_other_applications():
    rows = list(jpeg.segments(b"\xff\xd8" + segment(0xE0, b"AVI1\x02" + b"\0" * 9) + segment(0xE7, b"Ocad$Rev: 14797 $\0") + segment(0xE0, b"JFXX\0\x11\x02\x03")))
    assert rows[1]["fields"]["interleaved_label"] == "even field"
    assert rows[2]["fields"]["revision"] == "14797"
    assert (rows[3]["fields"]["extension_label"], rows[3]["fields"]["thumbnail_height"]) == ("1 byte per pixel", 3)


@pytest.mark.parametrize("data", [b"", b"\x00\x01", b"\xff\xd8\xff\xe0\x00", b"\xff\xd8" + segment(0xC0, b"\x08")])
def test_jpeg_faults_are_rows(data):
    rows = list(jpeg.segments(data))
    assert not data or rows[-1].get("error")


def tiff(order, rows):
    mark = {"<": b"II", ">": b"MM"}[order]
    out, extra = struct.pack(order + "H", len(rows)), b""
    at = 8 + 2 + 12 * len(rows) + 4
    for tag, kind, count, raw in rows:
        if len(raw) > 4:
            out += struct.pack(order + "HHII", tag, kind, count, at + len(extra))
            extra += raw
        else:
            out += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return mark + struct.pack(order + "HI", 42, 8) + out + b"\0\0\0\0" + extra


@pytest.mark.parametrize("order", "<>")
def test_exif_types(order):
    p = lambda code, *v: struct.pack(order + code, *v)
    data = tiff(order, [
        (0x100, 3, 1, p("H", 7)), (0x101, 4, 1, p("I", 70000)), (0x102, 3, 3, p("3H", 8, 8, 8)), (0x10F, 2, 6, b"Maker\0"), (0x11A, 5, 1, p("II", 72, 1)), (0x11B, 10, 1, p("ii", -1, 0)),
        (0x112, 3, 1, p("H", 6)), (0x13E, 12, 1, p("d", 0.5)), (0x9999, 3, 1, p("H", 1)),
    ])
    rows = {r["tag"]: r for r in exif.entries(data)}
    assert rows["ImageWidth"]["value"] == [7] and rows["ImageLength"]["value"] == [70000] and rows["BitsPerSample"]["value"] == [8, 8, 8]
    assert rows["Make"]["text"] == "Maker" and rows["XResolution"]["value"] == [72.0] and rows["YResolution"]["value"] == [None]
    assert rows["Orientation"]["label"] == "right-top" and rows["WhitePoint"]["value"] == [0.5] and len(rows) == 8


@pytest.mark.parametrize("data", [b"", b"II*\0\x04\0\0\0", b"XX*\0\x08\0\0\0", b"II*\0\xff\0\0\0"])
def test_exif_faults_are_rows(data):
    assert list(exif.entries(data))[-1]["error"]


@pytest.mark.parametrize("packed", [False, True])
def test_swf(packed):
    rows = list(swf.tags(movie_of(["one", "two"], packed)))
    assert named(rows) == ["Header", "SetBackgroundColor", "FrameLabel", "ShowFrame", "FrameLabel", "ShowFrame", "End"]
    assert rows[0]["fields"]["frame_rate"] == 24 and rows[0]["fields"]["frame_count"] == 2 and rows[1]["fields"]["color"] == "#102030"


def tag(code, body=b""):
    return struct.pack("<H", code << 6 | min(63, len(body))) + (struct.pack("<I", len(body)) if len(body) >= 63 else b"") + body


def movie(*tags):
    body = b"\x08\x00" + struct.pack("<HH", 256, 1) + b"".join(tags)
    return b"FWS" + bytes([6]) + struct.pack("<I", len(body) + 8) + body


def test_swf_dictionary_and_sprites(spark):
    sprite = struct.pack("<HH", 3, 1) + tag(43, b"inner\0") + tag(1) + tag(0)
    assets = struct.pack("<H", 2) + struct.pack("<H", 3) + b"first\0" + struct.pack("<H", 3) + b"second\0"
    data = movie(tag(39, sprite), tag(56, assets), tag(2, struct.pack("<H", 9) + b"\x08\x00"), tag(500, b"?" * 70), tag(26, b"\x02\x01\x00\x03\x00"), tag(1), tag(0))
    rows = list(swf.tags(data))
    assert [r["parent_path"] for r in rows if r["name"] == "FrameLabel"] == ["/0"]
    assert not [r for r in rows if r.get("error")]
    found = swf.swf_tags(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no"))], "path string, content binary"))
    chars = {r["id"]: r for r in swf.swf_characters(found).collect()}
    assert chars[3]["symbol"] == "first" and chars[9]["kind"] == "DefineShape"
    frames = swf.swf_frames(found).collect()
    assert [(r["frame_no"], r["placed"]) for r in frames] == [(0, 1)]
    heads = {r["path"]: r for r in swf.swf_header(found).collect()}
    assert heads["a"]["version"] == 6 and heads["b"]["error"] == "no header"


def test_swf_cut_off():
    rows = list(swf.tags(movie(tag(9, b"\1\2\3"))[:-2]))
    assert rows[-1]["error"] == "tag is cut off"
    assert list(swf.tags(b"CWS\x08\0\0\0\0junk"))[0]["error"].startswith("body")


def test_sniffed(spark):
    rows = [(image_of("a", 1), "JPEG"), (movie_of([], True), "SWF"), (b"GIF89a..", "GIF"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b" <a/>", "XML"), (b"\xa5", "PBJ"), (b"?", None)]
    df = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "content binary, kind string")
    assert all(r[0] == r[1] for r in df.select(jpeg.sniffed(df.content), "kind").collect())


def test_gpx_kml_garmin(spark):
    text = '<gpx><trkpt lat="43.6" lon="-116.1"><ele>100.5</ele><time>2003-05-24T17:09:00Z</time></trkpt><trkpt lat="1" lon="2"></trkpt></gpx>'
    logs = spark.createDataFrame([("a", text), ("b", None)], "path string, value string")
    assert [tuple(r) for r in tracks.gpx(logs).select(*tracks.PLACE).collect()] == [("a", 1053796140.0, 43.6, -116.1, 100.5)]
    logs = spark.createDataFrame([("k", "<kml><Placemark><when>1970-01-01T00:00:05Z</when><coordinates>2,1,7</coordinates></Placemark></kml>")], "path string, value string")
    assert [tuple(r) for r in tracks.kml(logs).select(*tracks.PLACE).collect()] == [("k", 5.0, 1.0, 2.0, 7.0)]
    logs = spark.createDataFrame([("g", "<Trackpoint><Time>1970-01-01T00:00:05Z</Time><Position><LatitudeDegrees>1</LatitudeDegrees><LongitudeDegrees>2</LongitudeDegrees></Position></Trackpoint>")], "path string, value string")
    assert [tuple(r) for r in tracks.garmin(logs).select(*tracks.PLACE).collect()] == [("g", 5.0, 1.0, 2.0, None)]


def test_nmea_and_igc(spark):
    lines = ["$GPRMC,235959.0,A,4330.0000,N,11606.0000,W,0,0,240503,,*1A", "$GPGGA,235959.0,4330.0000,N,11606.0000,W,1,5,1,99.5,M,,*00", "$GPGGA,000001.0,4331.0000,S,11606.0000,E,1,5,1,98.5,M,,*00", "$GPRMC,1,V,,,,,,,,*", "noise"]
    df = spark.createDataFrame([("n", k, x) for k, x in enumerate(lines)], "path string, line_no int, value string")
    rows = sorted(tuple(r) for r in tracks.nmea(df).select(*tracks.PLACE).collect())
    assert rows == [("n", 1053820799.0, 43.5, -116.1, 99.5), ("n", 1053820801.0, -(43 + 31 / 60), 116.1, 98.5)]
    df = spark.createDataFrame([("i", 0, "HFDTE240503"), ("i", 1, "B1709314338510N11603734WA0148501490")], "path string, line_no int, value string")
    (row,) = tracks.igc(df).collect()
    assert row["t"] == 1053796171.0 and abs(row["lat"] - (43 + 38.51 / 60)) < 1e-9 and row["lon"] < -116 and row["alt"] == 1490.0


def test_other_logs(spark):
    lines = ["$PTNTHPR,254.7,N,-1.7,N,-12.1,N,A*6E", "$GPRMC,112723.000,A,5040.3182,N,00505.9469,E,10.0,138.74,240410,,,A*51", "$GPGLL,5041.0000,N,00505.0000,E,112725.0,A", "$GPZDA,000001.0,25,04,2010,00,00", "$GPGLL,5042.0000,N,00505.0000,W,000002.0,A",
             "$PMGNTRK,4415.163,N,07631.126,W,00095,M,110833.53,A,,030409*68"]
    df = spark.createDataFrame([("n", k, x) for k, x in enumerate(lines)], "path string, line_no int, value string")
    rows = sorted(tracks.nmea(df).collect(), key=lambda r: r["t"])
    assert [r["t"] for r in rows] == [1238756913.53, 1272108443.0, 1272108445.0, 1272153602.0]
    assert (rows[1]["dir"], rows[1]["pitch"], rows[1]["roll"], rows[1]["speed"], rows[1]["track"]) == (254.7, -1.7, -12.1, 18.52, 138.74)
    assert rows[2]["dir"] is None and rows[3]["lon"] < 0 and rows[0]["alt"] == 95.0
    texts = ["TP,D, 44.933666667, -93.186555556, 10/26/2011, 19:07:28, 0", "   1 0001   42.721544   61.671879  249  25.21 21/04/2014 07:06:41  25.21    5.90    3.27 ypr", "noise ypr"]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(texts)], "path string, line_no int, value string")
    (row,) = tracks.winplus(df).collect()
    assert (row["t"], row["lat"], row["lon"]) == (1319656048.0, 44.933666667, -93.186555556)
    (row,) = tracks.bramor(df).collect()
    assert (row["t"], row["lat"], row["alt"], row["track"], row["dir"], row["pitch"], row["roll"]) == (1398064001.0, 42.721544, 249.0, 25.21, 25.21, 5.9, 3.27)
    kinds = [r[0] for r in df.select(tracks.log_kind(df.value)).collect()]
    assert kinds == ["Winplus", "Bramor", None]
    text = "<kml><Placemark><gx:Track><when>1970-01-01T00:00:05Z</when><when>1970-01-01T00:00:06Z</when><gx:coord>2 1 7</gx:coord><gx:coord>3 4 8</gx:coord></gx:Track></Placemark></kml>"
    logs = spark.createDataFrame([("k", text)], "path string, value string")
    assert sorted(tuple(r) for r in tracks.with_first(tracks.kml(logs)).select("t", "lat", "lon", "alt", "first").collect()) == [(5.0, 1.0, 2.0, 7.0, True), (6.0, 4.0, 3.0, 8.0, False)]


def test_overlays(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿SourceFile,Artist,Title\na.jpg,"x, ""y""\nz",one\na.jpg,,two\n*,-,any\n'.encode())
    rows = {r["SourceFile"]: r for r in overlays.read_csv(spark, str(tmp_path / "a.csv"), missing="-").collect()}
    assert rows["a.jpg"]["Title"] == "two" and rows["a.jpg"]["Artist"] is None and rows["*"]["deleted"] == ["Artist"]
    (tmp_path / "a.json").write_text(json.dumps([{"SourceFile": "b", "T": "base64:aGk="}, {"T": 5}]))
    rows = {r["SourceFile"]: r["T"] for r in overlays.read_json(spark, str(tmp_path / "a.json")).collect()}
    assert rows == {"b": "hi", "*": "5"}


def test_files(spark, tmp_path):
    from siftlens.sources.files import files

    for n in ("a.JPG", "b.swf", "c.txt", ".hidden/d.jpg"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(zlib.compress(b"x"))
    assert sorted(r["extension"] for r in files(spark, str(tmp_path), accept=("jpg", "swf")).collect()) == ["jpg", "swf"]
    assert sorted(r["extension"] for r in files(spark, str(tmp_path), reject=("txt",)).collect()) == ["jpg", "swf"]


def test_unpacked_files(spark):
    import bz2
    import gzip

    from siftlens.sources.files import unpacked

    rows = [("a.jpg.gz", gzip.compress(b"x" * 50)), ("b.bz2", bz2.compress(b"y")), ("c", b"plain"), ("d.gz", b"\x1f\x8bjunk"), ("e", None), ("f.gz", gzip.compress(b"z" * 500))]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    found = {r["path"]: r for r in unpacked(df, most=100).collect()}
    assert found["a.jpg"]["content"] == b"x" * 50 and found["b"]["content"] == b"y" and found["c"]["content"] == b"plain" and found["e"]["content"] is None
    assert found["d.gz"]["error"] or found["d"]["error"]
    assert [r["error"] for p, r in found.items() if p.startswith("f")] == ["more than 100 bytes"]


def test_small_image_headers(spark):
    from pyspark.sql import functions as F

    from siftlens.sources import sniff

    gif = b"GIF89a" + struct.pack("<HHBBB", 300, 20, 0xF6, 3, 0)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">IIBB", 640, 480, 8, 6)
    df = spark.createDataFrame([(bytearray(gif),), (bytearray(png),), (bytearray(b"?"),)], "b binary")
    rows = df.select(*[c.alias(f"g_{k}") for k, c in sniff.gif_header(F.col("b")).items()], *[c.alias(f"p_{k}") for k, c in sniff.png_header(F.col("b")).items()]).collect()
    assert (rows[0]["g_version"], rows[0]["g_width"], rows[0]["g_bits_per_pixel"], rows[0]["g_background"], rows[0]["p_width"]) == ("89a", 300, 7, 3, None)
    assert (rows[1]["p_width"], rows[1]["p_height"], rows[1]["p_bits_per_pixel"], rows[1]["p_alpha"], rows[1]["g_width"]) == (640, 480, 32, True, None)
    assert set(rows[2]) == {None}


@pytest.mark.parametrize("content, path, kind", [(b"%PDF-1.4", "a", "PDF"), (b"PK\3\4", "a", "ZIP"), (b"ID3", "a.mp3", "MP3"), (b"ID3", "a.txt", None), (b"II*\0", "", "TIFF"), (b"", "", None), (b"{\\rtf1", "", "RTF"), (b"\0\0\0\x18ftyp", "", "MOV")])
def test_magic(spark, content, path, kind):
    from pyspark.sql import functions as F

    from siftlens.sources import sniff

    df = spark.createDataFrame([(bytearray(content), path)], "b binary, p string")
    assert df.select(sniff.magic_type(F.col("b"), F.col("p"))).first()[0] == kind


def test_flv():
    from siftlens.sinks.video import flv

    data = flv([b"one", b"three"], codec=4, rate=10)
    assert data[:5] == b"FLV\x01\x01" and data[13] == 9 and data[24] == 0x14 and data[13 + 11 + 4 + 4 + 7 - 3 : 13 + 11 + 4 + 4 + 7] == (100).to_bytes(3, "big")
