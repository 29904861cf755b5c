"""What a file is, told by its first bytes, and what a small image's header says; all as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlens.functions.binary import bits, unsigned
from siftlens.functions.text import extension

# File types by an expression over the first bytes as Latin-1, in the order in which they are tried.
MAGIC = [
    ("JPEG", r"^\xff\xd8\xff"), ("PNG", r"^(\x89P|\x8aM|\x8bJ)NG\r\n\x1a\n"), ("GIF", r"^GIF8[79]a"), ("TIFF", r"^(II|MM)"), ("SWF", r"^[FC]WS[^\x00]"), ("FLV", r"^FLV\x01"),
    ("PDF", r"^\s*%PDF-\d+\.\d+"), ("PS", r"^(%!PS|%!Ad|\xc5\xd0\xd3\xc6)"), ("RIFF", r"^(RIFF|LA0[234]|OFR |LPAC|wvpk)"), ("ZIP", r"^PK\x03\x04"), ("GZIP", r"^\x1f\x8b\x08"), ("BZ2", r"^BZh[1-9]1AY&SY"),
    ("FLAC", r"^fLaC"), ("Real", r"^(\.RMF|\.ra\xfd|pnm://|rtsp://|http://)"), ("MOV", r"^.{4}(free|skip|wide|ftyp|pnot|PICT|pict|moov|mdat|junk|uuid)"), ("AIFF", r"^(FORM....AIF[FC]|AT&TFORM)"),
    ("BMP", r"^BM"), ("PSD", r"^8BPS\x00[\x01\x02]"), ("FITS", r"^SIMPLE  = {20}T"), ("RTF", r"^[\n\r]*\{[\n\r]*\\rtf"), ("VCard", r"(?i)^BEGIN:(VCARD|VCALENDAR)\r\n"), ("HTML", r"(?i)^(\xef\xbb\xbf)?\s*<(!DOCTYPE\s+HTML|HTML|\?xml)"),
    ("XMP", r"^\x00{0,3}(\xfe\xff|\xff\xfe|\xef\xbb\xbf)?\x00{0,3}\s*<"), ("Font", r"^((\x00\x01\x00\x00|OTTO|true|typ1)[\x00\x01]|\xff\x00|ttcf)"), ("MP3", r"^(ID3|\xff[\xe2-\xff])"),
]
#: Types whose signature is weak: they are believed only if the name says so too.
WEAK = {"MP3": ["mp3"]}


def magic_type(content: Column, path: Column | None = None) -> Column:
    """The first type whose signature fits, weak ones only with a fitting extension; else null."""
    top = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        fits = top.rlike(f"(?s){pattern}")
        if name in WEAK:
            fits = fits & (extension(path).isin(WEAK[name]) if path is not None else F.lit(False))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def gif_header(b: Column) -> dict[str, Column]:
    ok = F.hex(F.substring(b, 1, 6)).isin("474946383761", "474946383961")
    flags = unsigned(b, 10, 1)
    fields = {"version": F.decode(F.substring(b, 4, 3), "US-ASCII"), "width": unsigned(b, 6, 2, little=True), "height": unsigned(b, 8, 2, little=True), "bits_per_pixel": bits(flags, 0, 3) + 1, "background": unsigned(b, 11, 1), "aspect": unsigned(b, 12, 1)}
    return {k: F.when(ok, v) for k, v in fields.items()}


def png_header(b: Column) -> dict[str, Column]:
    """Bits per pixel count all channels of the colour type."""
    ok = F.hex(F.substring(b, 1, 8)) == "89504E470D0A1A0A"
    depth, kind = unsigned(b, 24, 1), unsigned(b, 25, 1)
    channels = F.when(kind == 2, 3).when(kind == 4, 2).when(kind == 6, 4).otherwise(1)
    fields = {"width": unsigned(b, 16, 4), "height": unsigned(b, 20, 4), "bits_per_pixel": depth * channels, "alpha": kind.isin(4, 6)}
    return {k: F.when(ok, v) for k, v in fields.items()}
