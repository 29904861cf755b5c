"""Exif data: the directories of a TIFF structure, their entries and values."""

import struct
from collections.abc import Iterator

# Entry types of TIFF, their sizes in bytes and struct codes.
TYPES = {1: ("BYTE", 1, "B"), 2: ("ASCII", 1, "s"), 3: ("SHORT", 2, "H"), 4: ("LONG", 4, "I"), 5: ("RATIONAL", 8, "II"), 6: ("SBYTE", 1, "b"), 7: ("UNDEFINED", 1, "s"), 8: ("SSHORT", 2, "h"), 9: ("SLONG", 4, "i"), 10: ("SRATIONAL", 8, "ii"), 11: ("FLOAT", 4, "f"), 12: ("DOUBLE", 8, "d")}

# Tags of the image, Exif and GPS directories.
IMAGE = {
    0xFE: "NewSubfileType", 0x100: "ImageWidth", 0x101: "ImageLength", 0x102: "BitsPerSample", 0x103: "Compression", 0x106: "PhotometricInterpretation",
    0x10E: "ImageDescription", 0x10F: "Make", 0x110: "Model", 0x111: "StripOffsets", 0x112: "Orientation", 0x115: "SamplesPerPixel", 0x116: "RowsPerStrip", 0x117: "StripByteCounts",
    0x11A: "XResolution", 0x11B: "YResolution", 0x11C: "PlanarConfiguration", 0x128: "ResolutionUnit", 0x12D: "TransferFunction", 0x131: "Software", 0x132: "DateTime", 0x13B: "Artist",
    0x13E: "WhitePoint", 0x13F: "PrimaryChromaticities", 0x201: "JPEGInterchangeFormat", 0x202: "JPEGInterchangeFormatLength", 0x211: "YCbCrCoefficients", 0x212: "YCbCrSubSampling",
    0x213: "YCbCrPositioning", 0x214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x8769: "ExifIFDPointer", 0x8825: "GPSInfoIFDPointer",
}
EXIF = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBias",
    0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote",
    0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension",
    0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile", 0xA005: "InteroperabilityIFDPointer", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode",
    0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation",
    0xA40A: "Sharpness", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID",
}
GPS = dict(enumerate((
    "GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack "
    "GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance "
    "GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential"
).split()))

# Labels of the commonest codes.
LABELS = {
    "Orientation": {1: "top-left", 2: "top-right", 3: "bottom-right", 4: "bottom-left", 5: "left-top", 6: "right-top", 7: "right-bottom", 8: "left-bottom"},
    "ResolutionUnit": {1: "none", 2: "inches", 3: "centimeters"},
    "ExposureProgram": {0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative program", 6: "Action program", 7: "Portrait mode", 8: "Landscape mode"},
    "MeteringMode": {0: "Unknown", 1: "Average", 2: "CenterWeightedAverage", 3: "Spot", 4: "MultiSpot", 5: "Pattern", 6: "Partial", 255: "Other"},
    "ColorSpace": {1: "sRGB", 65535: "Uncalibrated"},
    "YCbCrPositioning": {1: "centered", 2: "co-sited"},
    "WhiteBalance": {0: "Auto", 1: "Manual"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night scene"},
    "Contrast": {0: "Normal", 1: "Soft", 2: "Hard"},
    "Saturation": {0: "Normal", 1: "Low", 2: "High"},
    "Sharpness": {0: "Normal", 1: "Soft", 2: "Hard"},
}


def entries(data: bytes) -> Iterator[dict]:
    """Entries of the image directory, then of the Exif and GPS directories it points to: ifd, tag_id, tag, type, count,
    and the value as numbers, ratios or text. Unknown tags are left out; a fault ends the rows with one that tells it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield {"ifd": "", "error": "no TIFF header"}
        return
    at = struct.unpack_from(order + "I", data, 4)[0]
    if at < 8:
        yield {"ifd": "", "error": "directory before byte 8"}
        return
    todo = [("image", at, IMAGE)]
    while todo:
        ifd, at, known = todo.pop(0)
        if at + 2 > len(data):
            yield {"ifd": ifd, "error": "directory beyond the end"}
            continue
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                yield {"ifd": ifd, "error": "directory is cut off"}
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            if tag not in known or kind not in TYPES:
                continue
            name, size, code = TYPES[kind]
            start = place + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            row = {"ifd": ifd, "tag_id": tag, "tag": known[tag], "type": name, "count": count}
            raw = data[start : start + size * count]
            if len(raw) < size * count:
                yield row | {"error": "value beyond the end"}
                continue
            if code == "s":
                row["text" if kind == 2 else "hex"] = raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw.hex()
            elif len(code) == 2:
                pairs = struct.unpack(order + code * count, raw)
                row |= {"num": list(pairs[::2]), "den": list(pairs[1::2]), "value": [n / d if d else None for n, d in zip(pairs[::2], pairs[1::2], strict=True)]}
            else:
                row["value"] = list(struct.unpack(order + code * count, raw))
            if (label := LABELS.get(known[tag])) and row.get("value"):
                row["label"] = label.get(row["value"][0], f"Unknown ({row['value'][0]})")
            yield row
            if ifd == "image" and tag in (0x8769, 0x8825) and row.get("value"):
                todo.append(("exif", row["value"][0], EXIF) if tag == 0x8769 else ("gps", row["value"][0], GPS))
