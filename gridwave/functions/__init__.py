"""Column expressions of the codec's arithmetic; all of them are built-in functions."""

from .native import (
    band_size,
    big_endian,
    bit_planes,
    ceil_div,
    component_size,
    dequantized,
    geometry_fault,
    level_shift,
    mirror,
    sample_at,
    siz_fields,
    subband_step,
    unpack_step,
)

__all__ = [
    "band_size", "big_endian", "bit_planes", "ceil_div", "component_size", "dequantized", "geometry_fault", "level_shift", "mirror", "sample_at", "siz_fields", "subband_step", "unpack_step",
]
