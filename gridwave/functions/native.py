"""Geometry, steps, dequantization, shifts: Catalyst expressions, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codec.headers import MAX_AREA

_SIZ = ("x_size", "y_size", "x_off", "y_off", "tile_w", "tile_h", "tile_x_off", "tile_y_off")


def _long(c: Column | str | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("long")


def _floor_div(a: Column, b: Column) -> Column:
    """Rounds down for negative numbers too; exact below 2^53."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def ceil_div(a, b) -> Column:
    """a / b rounded up, for any sign of a and b > 0."""
    a, b = _long(a), _long(b)
    up = a + b - 1
    return _floor_div(up, b)


def component_size(size, offset, sampling) -> Column:
    """Width or height of a component on its own grid, never below 0."""
    s = F.greatest(_long(sampling), F.lit(1))
    return F.greatest(ceil_div(size, s) - ceil_div(offset, s), F.lit(0).cast("long"))


def band_size(size, nb, high) -> Column:
    """Columns or rows of a subband nb levels down; high: 1 for the high-pass side."""
    size, nb = _long(size), (F.lit(nb) if isinstance(nb, int) else nb).cast("int")
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), nb)
    half = F.when(_long(high) == 1, (whole / 2).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.greatest(_floor_div(size - half + whole - 1, whole), F.lit(0).cast("long"))


def big_endian(content: Column | str, offset: int, n: int) -> Column:
    """An unsigned field of n bytes at a byte offset, as a long; null where the bytes end before."""
    content = F.col(content) if isinstance(content, str) else content
    part = F.substring(content, offset + 1, n)
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def siz_fields(content: Column | str) -> Column:
    """The SIZ struct at its fixed place behind SOC; null if it isn't there."""
    at = {name: 8 + 4 * i for i, name in enumerate(_SIZ)}
    depth = big_endian(content, 42, 1)
    fields = [big_endian(content, o, 4).alias(n) for n, o in at.items()]
    fields += [big_endian(content, 40, 2).alias("components"), (depth.bitwiseAND(127) + 1).cast("int").alias("bit_depth"), (depth >= 128).alias("signed")]
    fields += [big_endian(content, 43 + i, 1).cast("int").alias(n) for i, n in enumerate(("x_sampling", "y_sampling"))]
    return F.when(big_endian(content, 0, 4) == 0xFF4FFF51, F.struct(*fields))


def geometry_fault(siz: Column | str) -> Column:
    """The fault kind of a SIZ struct, null if it is within the decoded subset; the first rule that fires counts."""
    s = F.col(siz) if isinstance(siz, str) else siz
    zero = lambda a, b: (s[a] == 0) | (s[b] == 0)
    return (
        F.when(s["components"] == 0, "Marker").when(s["components"] != 1, "Unsupported")
        .when(zero("x_size", "y_size"), "Marker")
        .when((s["x_off"] != 0) | (s["y_off"] != 0) | (s["tile_x_off"] != 0) | (s["tile_y_off"] != 0), "Unsupported")
        .when(zero("tile_w", "tile_h"), "Marker")
        .when((s["tile_w"] < s["x_size"]) | (s["tile_h"] < s["y_size"]), "Unsupported")
        .when(s["x_size"].cast("decimal(20,0)") * s["y_size"].cast("decimal(20,0)") > MAX_AREA, "Unsupported")
    )


def unpack_step(value, style) -> Column:
    """Struct of exponent and mantissa of a QCD entry; style: none, derived or expounded."""
    v = _long(value)
    none = (style if isinstance(style, Column) else F.lit(style)) == "none"
    return F.struct(
        F.when(none, F.shiftright(v, 3)).otherwise(F.shiftright(v, 11).bitwiseAND(31)).cast("int").alias("exp"),
        F.when(none, 0).otherwise(v.bitwiseAND(0x7FF)).cast("int").alias("mant"),
    )


def subband_step(qcd: Column | str, band: Column | str) -> Column:
    """The step of a band from struct<style, guard_bits, steps: array<struct<exp, mant>>>; null if there is none."""
    q, b = (F.col(x) if isinstance(x, str) else x for x in (qcd, band))
    first = F.try_element_at(q["steps"], F.lit(1))
    drop = F.floor(F.greatest(b - 1, F.lit(0)) / 3).cast("int")
    derived = F.struct(F.greatest(first["exp"] - drop, F.lit(0)).alias("exp"), first["mant"].alias("mant"))
    return F.when(q["style"] == "derived", derived).otherwise(F.try_element_at(q["steps"], (b + 1).cast("int")))


def bit_planes(guard_bits: Column, exponent: Column) -> Column:
    """Mb: magnitude bit-planes of a band."""
    return F.greatest(guard_bits + exponent - 1, F.lit(0))


def dequantized(q: Column, depth: Column, gain: Column, exponent: Column, mantissa: Column) -> Column:
    """(|q| + 1/2) step with the sign of q, 0 for 0; formed in double, returned as float."""
    step = (1 + mantissa / F.lit(2048.0)) * F.pow(F.lit(2.0), (depth + gain - exponent).cast("double"))
    return F.when(q == 0, F.lit(0.0)).otherwise(F.signum(q.cast("double")) * (F.abs(q) + F.lit(0.5)) * step).cast("float")


def level_shift(value: Column, depth: Column, signed: Column) -> Column:
    """Samples of a depth from wavelet output; long arithmetic, so nothing overflows."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), (depth - 1).cast("int"))
    v = value.cast("long")
    return F.when(signed, F.least(F.greatest(v, -half), half - 1)).otherwise(F.least(F.greatest(v + half, F.lit(0).cast("long")), half * 2 - 1))


def mirror(i: Column, n: Column) -> Column:
    """Whole-sample reflection of any index into 0 .. n - 1."""
    i, n = i.cast("long"), n.cast("long")
    period = F.greatest(2 * (n - 1), F.lit(1).cast("long"))
    k = F.pmod(i, period)
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.when(k < n, k).otherwise(period - k))


def sample_at(samples: Column | str, width: Column | str, height: Column | str, x: Column, y: Column) -> Column:
    """The sample at (x, y) of a row-major array; null outside the image."""
    s, w, h = (F.col(c) if isinstance(c, str) else c for c in (samples, width, height))
    return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.try_element_at(s, (y * w + x + 1).cast("int")))
