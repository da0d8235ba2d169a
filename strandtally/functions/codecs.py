"""Scalar expressions of offsets, sizes and ticks, as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 16_384  #: bases of a linear-index window
MAX_COMPRESSED = (1 << 47) - 1  #: keeps a packed offset within a signed 64-bit integer

# States of a span's records.
STATUS = {0: "ok", 1: "trailing bytes shorter than a record length", 2: "record shorter than its fixed fields", 3: "record extends past its span"}


def pack_offset(compressed: Column, within: Column) -> Column:
    """Virtual offset ``compressed << 16 | within``; an offset too large for a signed integer is an error."""
    fits = (compressed >= 0) & (compressed <= MAX_COMPRESSED) & (within >= 0) & (within < 65536)
    return F.when(fits, F.shiftleft(compressed.cast("long"), 16).bitwiseOR(within.cast("long"))).otherwise(F.raise_error(F.lit("virtual offset out of range")).cast("long"))


def offset_compressed(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def offset_within(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(65535)).cast("int")


def coordinate(ref_id: Column, window_start: Column) -> Column:
    """``ref_id << 32 | window_start``."""
    return F.shiftleft(ref_id.cast("long"), 32).bitwiseOR(window_start.cast("long"))


def window_start(pos: Column) -> Column:
    """First base of the window a position lies in."""
    return (F.floor(pos / WINDOW) * WINDOW).cast("long")


def padded(n: Column, to: int = 4) -> Column:
    return (F.floor((n + (to - 1)) / to) * to).cast("long")


def capacity_class(required: Column, largest: Column) -> Column:
    """The next power of two, at most ``largest``; null for nothing or for more than the largest."""
    power = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(1).cast("long"), lambda acc, i: F.when(acc < required, acc * 2).otherwise(acc))
    return F.when((required > 0) & (required <= largest), F.least(power, largest.cast("long")))


def tick_delta(start: Column, end: Column, valid_bits: int) -> Column:
    """Ticks from start to end on a counter of so many bits that wraps (fewer than 63 bits)."""
    mask = F.lit((1 << valid_bits) - 1)
    return (end.bitwiseAND(mask) - start.bitwiseAND(mask)).bitwiseAND(mask)


def status_text(status: Column) -> Column:
    out = F.when(status == 0, STATUS[0])
    for k in (1, 2, 3):
        out = out.when(status == k, STATUS[k])
    return out.otherwise(F.concat(F.lit("unknown status "), status.cast("string")))


def le_uint(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes from byte ``at`` (from 0) of a binary column."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long") * F.lit(256**i)
    out = byte(0)
    for i in range(1, size):
        out = out + byte(i)
    return out


def le_int(data: Column, at: int, size: int) -> Column:
    """The same, signed."""
    u = le_uint(data, at, size)
    return F.when(u >= 256**size // 2, u - 256**size).otherwise(u)
