"""Numbers inside binary columns, as Columns: integers of either byte order, bits, fixed point, geometry."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The unsigned integer of up to 7 bytes at an offset from 0; null where the data end before it."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    text = F.hex(part)
    if little:
        text = F.concat(*[F.substring(text, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))])
    return F.when(F.octet_length(part) == size, F.conv(text, 16, 10).cast("long"))


def signed(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    value = unsigned(data, at, size, little)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def bits(value: Column, low: int, width: int) -> Column:
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << width) - 1))


def sign_extended(value: Column, width: int) -> Column:
    return F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value)


def magnitude(value: Column, length: Column) -> Column:
    """A variable-length magnitude of so many bits: the lower half stands for negative numbers."""
    span = F.pow(F.lit(2.0), length).cast("long")
    return F.when(length == 0, 0).when(value >= span / 2, value).otherwise(value - span + 1)


def nibbles(value: Column) -> tuple[Column, Column]:
    return F.shiftright(value, 4).bitwiseAND(F.lit(15)), value.bitwiseAND(F.lit(15))


def fixed16(value: Column) -> Column:
    return value / 65536.0


def fixed8(value: Column) -> Column:
    return value / 256.0


def pixels(twips: Column) -> Column:
    return twips / 20.0


def blocks_across(size: Column, step: Column) -> Column:
    return F.ceil(size / step)


def zigzag(coefficients: Column) -> Column:
    """64 coefficients from diagonal order to rows: the diagonals of an 8 x 8 block, taken up and down by turns."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    place = {cell: k for k, cell in enumerate(cells)}
    return F.array(*[F.element_at(coefficients, place[r, c] + 1) for r in range(8) for c in range(8)])


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (r, g, b)])


def rgba_color(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """alpha from 0 to 255."""
    return F.concat(F.lit("rgba("), F.concat_ws(",", r.cast("string"), g.cast("string"), b.cast("string"), F.round(alpha / 255.0, 2).cast("string")), F.lit(")"))


def _ieee(sign: Column, power: Column, rest: Column, most: int, rest_bits: int) -> Column:
    size = (
        F.when(power == 0, rest * F.lit(2.0 ** (2 - (most + 1) // 2 - rest_bits)))
        .when((power == most) & (rest == 0), F.lit(float("inf")))
        .when(power == most, F.lit(float("nan")))
        .otherwise((1 + rest / F.lit(2.0**rest_bits)) * F.pow(F.lit(2.0), power - ((most + 1) // 2 - 1)))
    )
    return F.when(sign == 1, -size).otherwise(size)


def float32(bits_: Column) -> Column:
    """The value of a single-precision number's 32 bits, given as a whole number."""
    return _ieee(bits(bits_, 31, 1), bits(bits_, 23, 8), bits(bits_, 0, 23), 255, 23)


def float64(high: Column, low: Column) -> Column:
    """The value of a double-precision number's 64 bits, given as two halves."""
    return _ieee(bits(high, 31, 1), bits(high, 20, 11), bits(high, 0, 20) * F.lit(1 << 32) + low, 2047, 52)


def varint(data: Column, at: int = 0) -> Column:
    """The whole number at an offset whose bytes hold seven bits each, least first, and a mark that more follow; of five
    bytes at most."""
    byte = [F.coalesce(unsigned(data, at + k, 1), F.lit(0)) for k in range(5)]
    total, go_on = F.lit(0).cast("long"), F.lit(True)
    for k, b in enumerate(byte):
        total = total + F.when(go_on, b.bitwiseAND(F.lit(127)) * F.lit(1 << (7 * k))).otherwise(0)
        go_on = go_on & (b >= 128)
    return F.when(F.octet_length(data) > at, total)


def gradient_offset(ratio: Column) -> Column:
    return ratio / 256.0


def argb_color(alpha: Column, r: Column, g: Column, b: Column) -> Column:
    """All four from 0 to 255, as eight hexadecimal digits."""
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (alpha, r, g, b)])
