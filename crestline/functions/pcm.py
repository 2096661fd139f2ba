"""Sample encodings: every format to a float in [-1, 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, bits, floating, signed.
FORMATS = (
    ("S8", 8, False, True), ("U8", 8, False, False), ("S16", 16, False, True), ("U16", 16, False, False), ("S24", 24, False, True),
    ("U24", 24, False, False), ("S32", 32, False, True), ("U32", 32, False, False), ("F32", 32, True, True), ("F64", 64, True, True),
)


def to_float(value: Column, encoding: str) -> Column:
    """A stored number as a sample. All ten formats are supported; one division by a power of two, then one narrowing."""
    known = {name: (bits, floating, signed) for name, bits, floating, signed in FORMATS}
    if encoding not in known:
        raise ValueError(f"unknown sample format {encoding}")
    bits, floating, signed = known[encoding]
    if floating:
        return value.cast("float")
    half = float(1 << (bits - 1))
    return ((value.cast("double") - F.lit(0.0 if signed else half)) / half).cast("float")


def format_properties(name: Column) -> Column:
    """struct(bits, floating, signed) of a format's name; null for others."""
    out = F.lit(None)
    for encoding, bits, floating, signed in FORMATS:
        row = F.struct(F.lit(bits).alias("bits"), F.lit(floating).alias("floating"), F.lit(signed).alias("signed"))
        out = F.when(name == encoding, row).otherwise(out)
    return out


def rate_per_second(count: Column, seconds: Column) -> Column:
    """Throughput of a step; 0 without time."""
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))
