"""Packed colours.  The packer writes A, B, G, R; the unpacker reads A, R, G, B: a round trip swaps red and blue."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_color(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Alpha in the top byte, then blue, green, red; inputs are neither masked nor checked."""
    long = lambda c, n: F.shiftleft(c.cast("long"), n)
    return long(a, 24).bitwiseOR(long(b, 16)).bitwiseOR(long(g, 8)).bitwiseOR(r.cast("long"))


def unpack_color(color: Column) -> Column:
    """struct(a, r, g, b), read from the top byte down."""
    part = lambda n: F.shiftright(color.cast("long"), n).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(24).alias("a"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))
