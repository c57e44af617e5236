"""Encoded polylines as column expressions: differences of rounded coordinates, zigzag, five bits to a character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(encoded: Column, decimals: int = 5) -> Column:
    """array<struct<lon, lat>> of an encoded polyline: one fold over its code points; null for null, what follows a last whole pair is left out."""
    scale = float(10**decimals)
    long = lambda x: F.lit(x).cast("long")
    points = F.array().cast("array<struct<lon:double,lat:double>>")
    # held: bits of the number at hand; odd: it is a longitude; turn: its latitude's new value.
    start = F.struct(long(0).alias("held"), F.lit(0).alias("shift"), F.lit(False).alias("odd"), long(0).alias("lat"), long(0).alias("lon"), points.alias("points"))

    def step(acc, code):
        held = acc["held"].bitwiseOR(F.call_function("shiftleft", code.bitwiseAND(31).cast("long"), acc["shift"]))
        ends = code < 32
        change = F.when(held.bitwiseAND(1) == 1, -F.shiftright(held, 1) - 1).otherwise(F.shiftright(held, 1))
        lat = acc["lat"] + F.when(ends & ~acc["odd"], change).otherwise(long(0))
        lon = acc["lon"] + F.when(ends & acc["odd"], change).otherwise(long(0))
        one = F.array(F.struct((lon / scale).alias("lon"), (lat / scale).alias("lat")))
        return F.struct(
            F.when(ends, long(0)).otherwise(held).alias("held"), F.when(ends, F.lit(0)).otherwise(acc["shift"] + 5).alias("shift"), (acc["odd"] != ends).alias("odd"),
            lat.alias("lat"), lon.alias("lon"), F.when(ends & acc["odd"], F.concat(acc["points"], one)).otherwise(acc["points"]).alias("points"),
        )

    codes = F.transform(F.filter(F.split(encoded, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    return F.aggregate(codes, start, step, lambda acc: acc["points"])


def _number(v: Column) -> Column:
    """The characters of one difference."""
    zigzag = F.when(v < 0, -v * 2 - 1).otherwise(v * 2)
    groups = F.ceil(F.length(F.bin(zigzag)) / 5).cast("int")
    part = lambda k: F.call_function("shiftright", zigzag, k * 5).bitwiseAND(31) + F.when(k < groups - 1, 32).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda k: F.char(part(k) + 63)), "")


def encode(points: Column, decimals: int = 5) -> Column:
    """The encoded polyline of array<struct<lon, lat>>; null for null, empty for none."""
    scale = float(10**decimals)
    whole = F.transform(points, lambda p: F.struct(F.round(p["lat"] * scale).cast("long").alias("lat"), F.round(p["lon"] * scale).cast("long").alias("lon")))
    zero = F.struct(F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"))
    before = F.concat(F.array(zero), whole)
    pairs = F.zip_with(whole, F.slice(before, 1, F.size(whole)), lambda a, b: F.concat(_number(a["lat"] - b["lat"]), _number(a["lon"] - b["lon"])))
    return F.array_join(pairs, "")
