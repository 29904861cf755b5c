"""Named conversions: what users add to show a value, as functions of a Column. Nothing is evaluated from text."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlens.functions import numeric, text

Conversion = Callable[[Column], Column]

CONVERSIONS: dict[str, Conversion] = {
    "file_size": numeric.file_size, "duration": numeric.duration, "bit_rate": numeric.bit_rate, "exposure_time": numeric.exposure_time,
    "parameter": numeric.parameter, "html": text.html_escaped, "spoken": text.spoken_name, "upper": F.upper, "lower": F.lower,
}


def register(name: str, conversion: Conversion) -> None:
    """A conversion of one's own; a name is given once."""
    if name in CONVERSIONS:
        raise ValueError(f"{name} is taken")
    CONVERSIONS[name] = conversion


def converted(df: DataFrame, by: dict[str, list[str]]) -> DataFrame:
    """Columns after the conversions named for them, one after another."""
    out = {}
    for column, names in by.items():
        value = F.col(column)
        for name in names:
            value = CONVERSIONS[name](value)
        out[column] = value
    return df.withColumns(out)
